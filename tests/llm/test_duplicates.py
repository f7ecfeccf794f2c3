"""Repeated passages, near-duplicates and linked vectors against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from fleetlens.llm import near_duplicates, substring_dedup, vector_links
from fleetlens.llm.components import components
from fleetlens.llm.small_world import SmallWorld, audited_beam

from llm.texts import HARD, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passages() -> list[tuple[int | None, str | None]]:
    """Documents with shared passages at and around the least length, copies and repetition inside a text."""
    draw = random.Random(4)
    shared = [prose(900 + i, n).split() for i, n in enumerate((34, 35, 36, 60, 200))]
    rows: list[tuple[int | None, str | None]] = list(enumerate(HARD))
    for i in range(60):
        words = prose(i, draw.randrange(0, 150)).split()
        for part in draw.sample(shared, draw.randrange(0, 3)):
            at = draw.randrange(len(words) + 1)
            words[at:at] = part
        rows.append((100 + i, draw.choice([" ", "\n", "  "]).join(words)))
    rows += [(300 + i, "same same " * 40) for i in range(5)]
    rows += [(400, prose(1, 100)), (400, prose(1, 100)), (401, prose(2, 90) + " " + prose(2, 90)), (None, prose(1, 100))]
    return rows


def plain_repeats(rows, length=35):
    texts = [WORD.findall(t or "") for _, t in rows]
    count = collections.Counter(tuple(w[i : i + length]) for w in texts for i in range(len(w) - length + 1))
    found = []
    for (doc_id, text), words in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(words) - length + 1):
            if count[tuple(words[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        digest = hashlib.sha256(kept.encode()).hexdigest()
        found.append((doc_id, len(words), len(gone), digest, kept if gone else text or ""))
    return sorted(found, key=repr)


def test_repeated_passages(make):
    rows = passages()
    found = sorted((tuple(r) for r in substring_dedup.deduplicated(make(rows)).collect()), key=repr)
    assert found == plain_repeats(rows)
    assert substring_dedup.deduplicated(make([])).collect() == []


def test_carried_columns_do_not_clash(make):
    row = substring_dedup.deduplicated(make([(1, "a b")]), carry=True).first()
    assert row.kept == "a b" and row.n_words == 2 and row["rest"].n_words == "x" and row["rest"]["rest"] == 1


@pytest.mark.parametrize("length", [8, 9, 20])
def test_other_lengths(make, length):
    rows = passages()[20:50]
    found = sorted((tuple(r) for r in substring_dedup.deduplicated(make(rows), length=length, gram=4).collect()), key=repr)
    assert found == plain_repeats(rows, length)


def near_rows():
    draw = random.Random(8)
    rows: list[tuple[int | None, str | None]] = list(enumerate(HARD))
    base = [prose(50 + i, n).split() for i, n in enumerate((6, 12, 30, 90, 300, 700))]
    for i in range(120):
        words = list(draw.choice(base))
        for _ in range(draw.randrange(0, max(2, len(words) // 25))):
            words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
        text = " ".join(words)
        rows.append((200 + i, text.upper() if draw.random() < 0.1 and text.isascii() else text))
    rows += [(500 + i, prose(2000 + i, 80)) for i in range(30)]
    return rows + [(501, prose(2001, 80)), (None, prose(2001, 80))]


def plain_components(rows):
    def shingles(text):
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for _, t in rows]
    named = [k for k, (i, _) in enumerate(rows) if i is not None]
    root = {k: k for k in range(len(rows))}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, i in enumerate(named):
        for j in named[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for k in named:
        least[top(k)] = min(least.get(top(k), 10**9), rows[k][0])
    result = []
    for k, (doc_id, _) in enumerate(rows):
        component = None if doc_id is None else least[top(k)]
        result.append((doc_id, len(sets[k]), component, doc_id is None or component == doc_id))
    return sorted(result, key=repr)


def test_near_duplicates(make):
    rows = near_rows()
    found = sorted((tuple(r) for r in near_duplicates.deduplicated(make(rows)).collect()), key=repr)
    assert found == plain_components(rows)


def variants(seed: int, number: int) -> list[tuple[int, str]]:
    """Documents of four cores, each with some of the core's passages and a few changed words."""
    draw = random.Random(seed)
    rows = []
    cores = [prose(7000 + 10 * seed + i, 150).split() for i in range(4)]
    extras = [[prose(8000 + 100 * seed + 10 * i + j, 12).split() for j in range(4)] for i in range(4)]
    for doc in range(number):
        k = draw.randrange(4)
        words = list(cores[k])
        for part in draw.sample(extras[k], draw.randrange(0, 4)):
            at = 30 * draw.randrange(1, 5)
            words[at:at] = part
        for _ in range(draw.randrange(0, 4)):
            words[draw.randrange(len(words))] = f"w{draw.randrange(40)}"
        rows.append((doc, " ".join(words)))
    return rows


def test_variants_of_a_core_lose_no_link(make):
    """Ten groups of variants in one table, 600 documents of the first."""
    rows = [(1000 * seed + i, text) for seed in range(10) for i, text in variants(seed, 600 if seed == 0 else 100)]
    found = sorted((tuple(r) for r in near_duplicates.deduplicated(make(rows)).collect()), key=repr)
    assert found == plain_components(rows)


@pytest.mark.parametrize("seed", range(4))
def test_split_lists_lose_no_pair(spark, seed):
    """Pairs of one main component that can link are all formed, or both sides with the member of least weight."""
    draw = random.Random(seed)
    percent, size = 75, 80
    sets = {}
    for i in range(60):
        own = set(range(size)) - set(draw.sample(range(size), draw.randrange(0, 14)))
        own |= {1000 + x for x in draw.sample(range(30), draw.randrange(0, 14))}
        sets[i] = own
    rows = [(0, i, len(s) + draw.randrange(0, 4), i) for i, s in sets.items()]
    n = {i: m for _, i, m, _ in rows}
    members = spark.createDataFrame(rows, "main long, id long, n long, group long")
    shingles = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id long, shingle long")
    found = near_duplicates.apart(members, shingles, near_duplicates.Likeness())
    met = {frozenset((r.id, r.other)) for r in found.collect()}
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (n[a] + n[b] - both) and frozenset((a, b)) not in met:
                assert any(frozenset((a, c)) in met and frozenset((b, c)) in met for c in sets), (a, b)


def test_ties_without_common_differences_are_formed(spark):
    """Of a core of 59, one lacks nothing and one 11; 48 shared of a union of 64 are 75 percent."""
    members = spark.createDataFrame([(2, 2, 61, 2), (2, 1, 51, 1), (2, 3, 70, 2)], "main long, id long, n long, group long")
    sets = [(i, x) for i, lacking in ((2, 0), (1, 11), (3, 0)) for x in range(lacking, 59)]
    found = near_duplicates.apart(members, spark.createDataFrame(sets, "id long, shingle long"), near_duplicates.Likeness())
    assert (1, 51, 2, 61) in [tuple(r) for r in found.collect()]


def test_no_documents_and_none_alike(make):
    assert near_duplicates.deduplicated(make([])).collect() == []
    assert [tuple(r) for r in near_duplicates.deduplicated(make([(1, None)])).collect()] == [(1, 0, 1, True)]


def test_components_of_long_chains_and_hubs(spark):
    draw = random.Random(1)
    chain = list(range(1000, 1200))
    edges = [(a, b) for a, b in zip(chain, chain[1:], strict=False)] + [(5, x) for x in range(2000, 2300)]
    edges += [(5, 5), (None, 7), (9, 8), (8, 9)]
    draw.shuffle(edges)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    wanted = dict.fromkeys(chain, 1000) | dict.fromkeys([5, *range(2000, 2300)], 5) | {8: 8, 9: 8}
    assert found == wanted
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def vectors(spark):
    draw = np.random.default_rng(6)
    rows = []
    for label in (1, 2):
        centres = draw.normal(size=(12, 16))
        for i in range(150):
            v = centres[i % 12] + draw.normal(size=16) * (0.05 if i % 3 else 0.6)
            rows.append((len(rows), v.astype("float32").tolist(), label))
    rows += [(1000 + i, rows[0][1], 1) for i in range(20)]
    rows += [(2000, [x * 3 for x in rows[1][1]], 1), (2001, None, 1), (2002, [0.0] * 16, 1), (2003, rows[0][1], None)]
    rows += [(2004, [*rows[0][1][:15], None], 1), (2005, [*rows[0][1][:15], float("nan")], 1), (None, rows[0][1], 1)]
    rows += [(2006, [], 1), (2007, [float("inf")] * 16, 1), (2008, rows[0][1][:8], 1), (3, rows[3][1], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return rows, frame.selectExpr("*", "1 AS id", "2 AS shard")


@pytest.mark.parametrize(("shard", "lot"), [(8192, 16), (60, 16), (25, 2)])
def test_linked_vectors(spark, shard, lot):
    rows, frame = vectors(spark)
    found = vector_links.linked(frame, vector_links.Linking(shard=shard, lot=lot)).collect()
    assert len(found) == len(rows)
    good = [(k, i, np.array(v, float), lab) for k, (i, v, lab) in enumerate(rows)
            if i is not None and v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = collections.Counter()
    root = {i: i for _, i, _, _ in good}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, i, v, lab in good:
        for b, j, w, other in good:
            if a < b and lab == other and len(v) == len(w) and v @ w >= 0.93 * np.linalg.norm(v) * np.linalg.norm(w):
                links[a] += 1
                links[b] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    wanted = sorted((rows[k][0], links[k], top(rows[k][0])) for k, *_ in good)
    clear = sorted((r.vec_id, r.n_links, r.component_id) for r in found if r.vec_id in root)
    hits = sum(min(a[1], b[1]) for a, b in zip(wanted, clear, strict=True))
    assert hits >= 0.98 * sum(links.values()) and all(b[1] <= a[1] for a, b in zip(wanted, clear, strict=True))
    if hits == sum(links.values()):
        assert clear == wanted
    alone = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found if r.vec_id not in root}
    assert alone == {i: (0, i, True) for i in (*range(2001, 2008), None) if i not in root}
    assert vector_links.linked(frame.limit(0)).collect() == []


def test_links_count_at_both_ends_even_where_some_are_missed(spark):
    _, frame = vectors(spark)
    frame = frame.where("vec_id < 2000").dropDuplicates(["vec_id"])
    whole = sum(r.n_links for r in vector_links.linked(frame).collect())
    for how in (vector_links.Linking(shard=25, lot=2, beam=1, recall=0.0), vector_links.Linking(beam=1, recall=0.0)):
        found = vector_links.linked(frame, how).collect()
        sizes = collections.Counter(r.component_id for r in found)
        assert sum(r.n_links for r in found) % 2 == 0 and 0 < sum(r.n_links for r in found) <= whole
        assert all((r.n_links > 0) == (sizes[r.component_id] > 1) for r in found)


def test_audit_with_vectors_of_another_shard():
    draw = np.random.default_rng(4)
    centre = draw.normal(size=24)
    table = np.concatenate([draw.normal(size=(900, 24)), centre + 0.3 * draw.normal(size=(300, 24))])
    asked = np.concatenate([draw.normal(size=(300, 24)), centre + 0.3 * draw.normal(size=(100, 24))])
    table, asked = (t / np.linalg.norm(t, axis=1, keepdims=True) for t in (table, asked))
    graph = SmallWorld(table)
    beam = audited_beam(graph, asked, 0.93, 1, 0.99, 64)
    wanted = [set(np.flatnonzero(table @ q >= 0.93).tolist()) for q in asked]
    hits = sum(len(w & set(graph.within(q, 0.93, beam).tolist())) for w, q in zip(wanted, asked, strict=True))
    assert hits >= 0.97 * sum(map(len, wanted)) > 0
    assert audited_beam(graph, asked[:0], 0.93, 8, 0.99, 64) == 8


def test_graph_recall_and_audit():
    draw = np.random.default_rng(9)
    table = draw.normal(size=(1500, 32))
    table[500:700] = table[0] + 0.1 * draw.normal(size=(200, 32))
    table /= np.linalg.norm(table, axis=1, keepdims=True)
    graph = SmallWorld(table)
    beam = audited_beam(graph, graph.vectors, 0.9, 16, 0.98, 64)
    hits = total = 0
    for k in range(0, 1500, 7):
        near = set(np.flatnonzero(table @ table[k] >= 0.9))
        hits += len(near & set(graph.within(table[k], 0.9, beam).tolist()))
        total += len(near)
    assert hits >= 0.95 * total
