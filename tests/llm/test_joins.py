"""Operators that bring rows together, against brute force: similarity, neighbours, host links, conversations."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frostline.llm import chat, jaccard_join, nearest, url_filters
from frostline.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Jaccard join


def shingles(text):
    words = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def plain_components(rows):
    """(doc_id, n_shingles, component) of each row by comparing all pairs that share a shingle."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x]).items():
            if 100 * n >= 90 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    smallest = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted(str((d, len(s), smallest[find(i)] if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(seed):
    """Texts with chains of edits around the threshold, families of one base, and boilerplate shared by strangers."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    rows, boiler = [], [word() for _ in range(60)]
    for family in range(40):
        base = [word() for _ in range(rng.choice([1, 2, 3, 4, 9, 12, 20, 31, 60, 150, 700]))]
        if family % 5 == 0:
            base = boiler + base
        for _ in range(rng.choice([1, 2, 5, 12])):
            text = list(base)
            for _ in range(rng.randrange(0, 2 + len(base) // 40)):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(2)] = [word()]
            rows.append(" ".join(text))
            if rng.random() < 0.4:
                base = text
    rows += rows[:5] + [r.upper() for r in rows[5:8]] + [None, "", " \n"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("tile", [1_000_000, 200])
def test_components_as_by_brute_force(spark, tile):
    rows = near_copies(4)
    out = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), jaccard_join.Settings(tile_shingles=tile))
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in out.collect()) == plain_components(rows)


def test_messy_documents(messy, empty):
    rows = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    out = jaccard_join.join(messy).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in out) == plain_components(rows)
    assert jaccard_join.join(empty).count() == 0
    kept = jaccard_join.without_copies(messy)
    assert kept.columns == messy.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 8, 9, None, None]))


@pytest.mark.parametrize("percent", [90, 80])
def test_linked_sets_share_a_group(percent):
    rng, settings = np.random.default_rng(2), jaccard_join.Settings(percent=percent)
    for size in [*range(4, 60), 100, 333, 1000, 5000]:
        for _ in range(20):
            left = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            drop = rng.integers(0, jaccard_join.most_different(size, percent) + 1)
            lose = rng.integers(0, drop + 1)
            right = np.unique(np.concatenate([left[lose:], rng.integers(0, 2**63, drop - lose).astype(np.uint64)]))
            common = len(np.intersect1d(left, right))
            linked = 100 * common >= percent * (len(left) + len(right) - common)
            assert jaccard_join._linked(left, right, percent) == linked
            if linked and not len(left) == len(right) == common:
                assert set(jaccard_join.group_keys(left, settings)) & set(jaccard_join.group_keys(right, settings))


def test_sets_at_the_threshold_share_a_group():
    """Subsets as small as the threshold lets them be: the partners that differ in size the most."""
    rng, settings = np.random.default_rng(5), jaccard_join.Settings()
    for size in range(10, 1500, 7):
        left = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        right = left[size - -(-90 * size // 100) :]
        assert jaccard_join._linked(left, right, 90)
        assert set(jaccard_join.group_keys(left, settings)) & set(jaccard_join.group_keys(right, settings))


@pytest.mark.parametrize("partitions", [1, 7])
def test_sets_under_one_key_are_connected(spark, partitions):
    """Also a key that goes on over several partitions, and sets that give a key twice."""
    rows = [(i, [5, 6]) for i in range(300)] + [(0, [5]), (900, [7]), (901, [7, 8]), (902, [9]), (299, [9, -3]), (950, [])]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sets = spark.createDataFrame(rows, "fa long, keys array<long>")
        got = {r.in_cluster: r.root for r in jaccard_join._clusters(sets).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: 0 for i in range(300)} | {902: 0, 900: 900, 901: 900}


@pytest.mark.parametrize("run", [1 << 17, 8])
def test_shared_passages_chain_no_strangers(spark, monkeypatch, run):
    """Only sets whose first keys, rare ones first, meet are looked at; keys may come in pieces and with repeated rows."""
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, settings = text(60), jaccard_join.Settings(words=5, percent=80)
    rows = [f"{passage} {text(200 + i % 90)}" for i in range(60)]
    rows += [f"{rows[7]} {text(9)}", rows[3]]
    documents = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    # A task would hold more in a run than these tables have: what it yields is the same whatever it holds.
    keys = {k: sorted(i for i, r in enumerate(rows[:-1]) if k in jaccard_join.group_keys(
        jaccard_join.shingle_set(r, 5, jaccard_join.WordHashes()), settings).tolist())
        for k in jaccard_join.group_keys(jaccard_join.shingle_set(rows[7], 5, jaccard_join.WordHashes()), settings).tolist()}
    monkeypatch.setattr(jaccard_join, "RUN", run)
    flat = pd.DataFrame([(k, i) for k in sorted(keys) for i in keys[k] for _ in range(2)], columns=["key", "fa"])
    out = pd.concat(jaccard_join._shared(flat[i : i + 7] for i in range(0, len(flat), 7)))
    sizes = out[out["fa"].isna()].groupby("key")["n"].sum()
    got = {(k, i, int(sizes[k] if pd.isna(n) else n)) for k, i, n in out[out["fa"].notna()].itertuples(index=False)}
    assert {x for x in got if x[2] > 1} == {(k, i, len(v)) for k, v in keys.items() if len(v) > 1 for i in v}
    sets, keyed = jaccard_join._described(documents, settings)
    clusters = jaccard_join._clusters(jaccard_join._telling(keyed, sets)).collect()
    pair = {r.fa for r in sets.where("doc_id in (7, 60)").collect()}
    assert len(pair) == 2 and {r.in_cluster for r in clusters} == pair and len({r.root for r in clusters}) == 1
    got = {r.doc_id: r.component_id for r in jaccard_join.join(documents, settings).collect()}
    assert got == {i: i for i in range(60)} | {60: 7, 61: 3}


def test_tree_passes_over_no_link():
    rng = np.random.default_rng(7)
    base = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in rng.integers(20, 400, 150)]
    sets = base + [np.unique(np.concatenate([s[len(s) // 30 :], rng.integers(0, 2**63, 2).astype(np.uint64)])) for s in base]
    tree = jaccard_join.CountTree(sets, 32, 8, 4)
    for i, s in enumerate(sets):
        near = set(tree.near(tree.points[i], len(s), 90).tolist())
        assert {j for j, other in enumerate(sets) if jaccard_join._linked(s, other, 90)} <= near
    assert np.mean([len(tree.near(tree.points[i], len(s), 90)) for i, s in enumerate(sets)]) < 20


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 100)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {i: 1000 for i in range(1000, 1100)}


# Neighbours


def brute_force(rows, k):
    usable = {(i, tuple(np.float32(v).astype(float) for v in x)) for i, x in rows
              if i is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)}
    out = {}
    for q, x in usable:
        if q % 20 == 0:
            ranked = sorted((-float(np.dot(x, y)), i) for i, y in usable if i != q and len(x) == len(y))
            out[q] = [(i, -s) for s, i in ranked[:k]]
    return out


def test_recall_against_brute_force(spark):
    embeddings = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in embeddings.collect()]
    want = brute_force(rows, 20)
    found = hits = 0
    got = defaultdict(list)
    for r in nearest.search(embeddings, F.col("vec_id") % 20 == 0, nearest.Settings(block_rows=600, query_rows=40)).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for q, expected in want.items():
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, 21))
        assert [(-s, i) for _, i, s in sorted(got[q])] == sorted((-s, i) for _, i, s in got[q])
        found, hits = found + 20, hits + len({i for i, _ in expected} & {i for _, i, _ in got[q]})
    assert hits / found >= 0.95


def test_messy_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
            (6, [float("inf"), 1.0]), (7, [1.0, None]), (8, []), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (20, [30.0, -5.0]),
            (10, [100.0, 0.5]), (40, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as block", "2 as part", "3 as score")
    got = defaultdict(list)
    for r in nearest.search(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == brute_force(rows, 20)
    assert nearest.search(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_few_vectors_are_verified():
    """The collisions tell near from far: most of the vectors needn't be compared, and the nearest are found."""
    rng = np.random.default_rng(11)
    vectors = rng.standard_normal((6000, 64))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    index, asked = nearest.Index(vectors, nearest.Settings()), np.arange(0, 6000, 100)
    results = index.search(vectors[asked], [np.array([i]) for i in asked])
    hits = 0
    for i, (found, products) in zip(asked, results, strict=True):
        assert i not in found and len(set(found.tolist())) == len(found)
        assert np.allclose(products, vectors[found] @ vectors[i])
        order = np.argsort(-(vectors @ vectors[i]))
        hits += len(set(order[1:21].tolist()) & set(found.tolist()))
    assert hits / (20 * len(asked)) >= 0.95
    assert np.mean([len(found) for found, _ in results]) < 0.25 * len(vectors)


def test_totals_of_windows():
    rng = np.random.default_rng(1)
    for count in (1, 2, 3, 7, 8, 40, 255):
        bits = rng.random((count, 2, 192)) < 0.6
        digits = nearest._totals(iter(np.packbits(b, axis=1).view(np.uint64) for b in bits))
        for least in (1, 5, 24, 160, 300):
            got = np.unpackbits(nearest._at_least(digits, least).view(np.uint8), axis=1).astype(bool)
            assert (got == (bits.sum(axis=0) >= least)).all()


def test_stop_width_keeps_the_promise():
    settings = nearest.Settings()
    width, rng = nearest.stop_width(settings), np.random.default_rng(0)
    hits = (np.abs(rng.standard_normal((20_000, settings.projections))) <= width).sum(axis=1)
    assert (hits < settings.collisions).mean() < settings.miss * 1.2


# Hosts

RULES = url_filters.Rules((("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")))


def test_rules_and_parts_of_urls(spark):
    cases = {
        "http://A.Example.NET/en/x?y": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/EN/": ("example.net", "/EN/", "net/", "block"), "http://net/": ("net", "/", "net/", "block"),
        "http://net": ("net", "", None, "block"),  # no rule fits the empty path; the host's other page is blocked
        "x://myexample.com/de/": ("myexample.com", "/de/", None, "allow"),
        "q://É.com#://b/": ("É.com", "", None, "allow"), "no scheme/": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "a://b.org/fr/#x": ("b.org", "/fr/", "org/fr/", "allow"), "a://b?c://d.net/": ("b", "", None, "allow"), "": ("", "", None, "allow"),
        "://x.net/a\nb?c": ("x.net", "/a\nb", "net/", "block"),
    }
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(cases)], "page_id long, url string, html string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, RULES).collect()}
    assert out == dict(enumerate(cases.values()))


def test_scores_as_by_dense_iteration(spark):
    rng = random.Random(3)
    hosts = [f"h{i}.com" for i in range(12)] + ["bad.net", "worse.net", "good.org"]
    pages = []
    for i in range(80):
        host = rng.choice(hosts)
        html = "".join(f'<a HREF="http://{rng.choice(hosts)}/x">' for _ in range(rng.randrange(4))) + f"<a href='//{host}/y'><a href=/z>"
        pages.append((i, f"http://{host}/{rng.choice(['fr/', 'x'])}", html))
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("score", F.lit(1))
    out = url_filters.judge(table, RULES).collect()
    place = {h: i for i, h in enumerate(hosts)}
    links, seeds = np.zeros((15, 15)), np.zeros((2, 15))
    for _, url, html in pages:
        h = place[url.split("/")[2]]
        for target in re.findall(r'HREF="http://([^/]*)', html):
            links[h, place[target]] += target != url.split("/")[2]
    for h in range(15):
        own = [u for _, u, _ in pages if u.split("/")[2] == hosts[h]]
        actions = ["block" if hosts[h].endswith(".net") else "allow" if hosts[h].endswith(".org") and "/fr/" in u else "" for u in own]
        seeds[:, h] = [actions.count(a) / max(len(own), 1) for a in ("allow", "block")]
    shares = links / np.maximum(links.sum(axis=1, keepdims=True), 1e-9)
    for seed, steps, column in ((seeds[0], shares, "trust"), (seeds[1], shares.T, "distrust")):
        front = total = seed
        for _ in range(60):
            front = 0.7 * front @ steps
            total = total + front
        for r in out:
            assert abs(r[column] - total[place[r.host]]) < 1e-3
    for r in out:
        if r.rule is None:
            assert r.verdict == ("block" if r.distrust >= 0.5 and r.distrust > r.trust else "allow")
    assert url_filters.judge(table.where("false"), RULES).count() == 0


@pytest.mark.parametrize("linkers", [2, 1000])
def test_hosts_that_link_only_to_blocked_ones(spark, linkers):
    pages = [("http://bad.net/x", "")] + [(f"http://only{i}.com/", "<a href=http://bad.net/x>") for i in range(linkers)]
    pages += [(f"http://few{i}.com/", "<a href=http://bad.net/><a href=http://fine.com/><a href=//fine.com/>") for i in range(linkers)]
    pages += [("http://fine.com/", "<a href='/go?u=http://bad.net/x'><a href='?//bad.net/'>")]
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    out = {r.host: (r.verdict, r.distrust) for r in url_filters.judge(table, RULES).collect()}
    assert all(out[f"only{i}.com"] == ("block", pytest.approx(0.7)) for i in range(linkers))
    assert all(out[f"few{i}.com"] == ("allow", pytest.approx(0.7 / 3)) for i in range(linkers))
    assert out["fine.com"] == ("allow", 0.0)


# Conversations


def plain_render(rows, block=1024):
    talks = defaultdict(set)
    for conv, turn, role, text in rows:
        talks[conv].add((turn, role, text))
    ordered = {c: tuple(sorted(t, key=lambda x: (x[0] is not None, x[0] or 0))) for c, t in talks.items()}
    plain = {c: tuple((r, x) for _, r, x in t) for c, t in ordered.items()}
    out = []
    for c, turns in plain.items():
        same = [o for o in plain if plain[o] == turns]
        inside = any(len(o) > len(turns) and o[: len(turns)] == turns for o in plain.values())
        if not inside and c == min((o for o in same if o is not None), default=None):
            for part in range(-(-len(turns) // block)):
                own = ordered[c][part * block : (part + 1) * block]
                text = "".join(f"<|{'unknown' if r is None else r}|>\n{x or ''}<|end|>\n" for _, r, x in own)
                out.append((c, part, len(turns), len(same), text))
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 2])
def test_collapse_as_by_brute_force(spark, block):
    rng, rows = random.Random(8), []
    for conv in range(150):
        if conv % 3 and rows:
            source = rng.randrange(conv)
            old = [r[1:] for r in rows if r[0] == source]
            own = old[: rng.randrange(1, len(old) + 1)]
            own += [(own[-1][0] + 7, "user", f"new {rng.randrange(3)}")] * (conv % 2)
        else:
            own = [(i, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None])) for i in range(rng.randrange(1, 7))]
        rows += [(conv, *r) for r in own]
    rows += [(200, None, "user", "a"), (200, 0, "x", "b"), (201, 0, "", None), (202, 0, None, "")]
    table = spark.createDataFrame(rows + rows[:30], "conv_id long, turn long, role string, text string").withColumn("h1", F.lit(1))
    for crowded in (1 << 16, 2):
        out = chat.render(table, chat.Settings(turn_block=block, crowded=crowded))
        assert sorted(tuple(r) for r in out.collect()) == plain_render(rows, block)


def test_turns_of_one_number_have_one_order(spark):
    rows = [(c, 0, "user", "start") for c in (1, 2, 3)] + [(c, 1, "user", t) for c in (1, 2) for t in ("abcde" if c == 1 else "edcba")]
    out = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.conv_id, r.n_turns, r.n_copies) for r in out] == [(1, 6, 2)]
    assert sorted(re.findall(r"\n(\w)<", out[0].rendered)) == list("abcde")


def test_conversations_without_id_or_turns(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "user", "b"), (1, 0, "user", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.render(table).collect()
    assert [(r.conv_id, r.n_turns) for r in out] == [(None, 2)]
    assert chat.render(table.where("false")).count() == 0


def test_a_third_of_all_turns_without_id_or_number(spark):
    """No group of the plan grows with a conversation: shards and parts stay near turn_block rows."""
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("conv_id"), F.when(F.col("id") % 3 > 0, F.lit(0)).alias("turn"),
        F.lit("user").alias("role"), F.col("id").cast("string").alias("text"),
    )
    numbered = rows.union(spark.range(6000).selectExpr("null", "id % 2", "'user'", "concat('n', id)"))
    settings = chat.Settings(turn_block=64, crowded=1000)
    out = chat.render(numbered.union(numbered), settings).collect()
    own = sorted((r for r in out if r.conv_id is None), key=lambda r: r.part)
    assert [r.part for r in own] == list(range(250)) and all(r.n_turns == 16000 for r in own)
    assert all(r.rendered.count("<|user|>") == 64 for r in own) and len(out) == 20250
    texts = re.findall(r"\n(n?\d+)<", "".join(r.rendered for r in own))
    assert sorted(texts) == sorted([str(i) for i in range(0, 30000, 3)] + [f"n{i}" for i in range(6000)])
    assert [t[0] == "n" for t in texts] == [False] * 10000 + [True] * 6000
    assert [int(t[1:]) % 2 for t in texts[10000:]] == [0] * 3000 + [1] * 3000
    sizes = chat._sharded(numbered, settings).groupBy("conv_id", "shard").count().agg(F.max("count")).first()[0]
    assert sizes < 3 * 64


# The pipeline's copies


def test_pipeline_takes_near_copies_at_five_words_and_four_fifths(spark):
    """A copy with 12 % cut off, one with 10 of 500 words edited; rows without an id are copies like any others."""
    import corpus_pipeline

    def words(salt, n=500):
        return [f"{salt}{i}" for i in range(n)]

    edited = ["edit" if i % 50 == 25 else w for i, w in enumerate(words("a"))]
    rows = [(1, words("a")), (2, words("a")[:440]), (3, edited), (4, words("a")[:300]), (5, words("b")),
            (None, words("a")), (None, words("a")[:440]), (None, words("c")), (None, words("c")), (None, words("c")[:440]),
            (None, []), (None, [])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    kept = corpus_pipeline.drop_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 4, 5]
    assert sorted(r.text[:1] for r in kept if r.doc_id is None) == ["", "", "c"]


def test_python_gets_small_batches_while_tables_are_written(spark):
    from frostline.sources.shared import written

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [int(batch["text"].str.len().sum())]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    texts = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("text "), 1000).alias("text"))
    found = [r.n for r in written(texts.mapInPandas(sizes, "n long"), "sizes").collect()]
    assert sum(found) == 30_000_000 and max(found) < 6_000_000  # before: 30,000,000 in one
    assert spark.conf.get(key) == before


def test_counts_of_a_tile_are_held_once():
    import tracemalloc

    from frostline.llm.text import mixed

    sets = [np.unique(np.random.default_rng(i).integers(0, 1 << 63, 40).astype(np.uint64)) for i in range(2000)]
    tracemalloc.start()
    try:
        tree = jaccard_join.CountTree(sets, 1024, 32, 16)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3 * tree.points.nbytes  # the counts and their copy in order; before: four times
    for point, s in zip(tree.points, sets, strict=True):
        assert (point == np.bincount((mixed(s) >> np.uint64(17)) % np.uint64(1024), minlength=1024)).all()
