"""Quality rules, importance resampling and personal data against plain versions."""

import collections
import hashlib
import random
import re
import time

import numpy as np
from fleetlens.llm import boosting, importance, private_data, quality_rules

from llm.texts import HARD, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    triples = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    repeats = len(covered)
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeats, failed


def quality_rows():
    rows = list(enumerate(HARD)) + [(100 + i, prose(i, 20 + 4 * i)) for i in range(60)]
    rows += [(200, "one two three four " * 30), (201, "line\nline\n \n\nother\nline"), (None, "the " * 60)]
    rows += [(300 + i, " ".join(w.upper() + "!!" for w in prose(i, 200).split())) for i in range(3)]
    rows += [(400 + i, " ".join(f"{w}$$$ ###" for w in prose(i, 200).split())) for i in range(3)]
    return rows


def test_base_counts_and_verdict(make):
    rows = quality_rows()
    docs = make(rows)
    found = quality_rules.rated(docs, quality_rules.language_references(docs)).collect()
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((tuple(r[c] for c in columns) for r in found), key=repr) == sorted(
        ((i, *plain_counts(t)) for i, t in rows), key=repr
    )
    kept = {r.doc_id: r.kept for r in found}
    assert all(kept[100 + i] for i in range(20, 60)) and not any(kept[i] for i in (*range(300, 303), *range(400, 403)))
    assert not any(r.kept for r in found if r.base_failed)


def test_distances_are_those_of_the_definition(make):
    rows = [(i, prose(i, 300)) for i in range(8)]
    docs = make(rows)
    references = quality_rules.language_references(docs)
    words = collections.Counter(w for _, t in rows for w in WORD.findall(t))
    best = dict(sorted(words.items(), key=lambda x: (-x[1], x[0]))[:64])
    assert references.words["en"] == best and references.words[quality_rules.POOLED] == best

    def divergence(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        part = [sum(a * np.log2(a / c) for a, c in zip(x, m, strict=True) if a) for x in (p, q)]
        return (sum(part) / 2) ** 0.5

    for r in quality_rules.rated(docs, references).collect():
        own = collections.Counter(w for w in WORD.findall(dict(rows)[r.doc_id]) if w in best)
        p = [own[w] / own.total() for w in best]
        q = [n / sum(best.values()) for n in best.values()]
        assert abs(divergence(p, q) - r.word_distance) < 1e-9


def test_empty_tables_and_unknown_languages(spark, make):
    empty = make([])
    assert quality_rules.rated(empty, quality_rules.language_references(empty)).collect() == []
    docs = make([(1, prose(1, 200)), (2, None)], lang=None)
    assert {r.doc_id: r.kept for r in quality_rules.rated(docs, quality_rules.language_references(docs)).collect()} == {1: True, 2: False}
    few = quality_rules.Limits(languages=1)
    mixed = make([(1, prose(1, 900))]).unionByName(make([(2, prose(2, 500))], lang="xx"))
    references = quality_rules.language_references(mixed, few)
    assert set(references.words) == {"en", quality_rules.POOLED}
    assert all(r.kept for r in quality_rules.rated(mixed, references, few).collect())


def test_every_language_is_judged_by_its_own_words(make):
    few = quality_rules.Limits(languages=1)
    own = {"en": "", "xx": "q", "yy": "z", "*": "v"}
    parts = {lang: [" ".join(w + end for w in prose(10 * k + i, 700 + 900 * (lang == "en")).split()) for i in range(4)]
             for k, (lang, end) in enumerate(own.items())}
    rows = [(100 * k + i, t, lang) for k, (lang, texts) in enumerate(parts.items()) for i, t in enumerate(texts)]
    rows += [(900, " ".join(w + "q" for w in prose(77, 120).split()), "zz"), (901, parts["xx"][0], "yy")]
    docs = None
    for i, text, lang in rows:
        one = make([(i, text)], lang=lang)
        docs = one if docs is None else docs.unionByName(one)
    wanted = {r.doc_id: r for r in quality_rules.rated(docs, quality_rules.language_references(docs)).collect()}
    references = quality_rules.language_references(docs, few)
    assert set(references.words) == {"en", quality_rules.POOLED} and references.others.count() == 4
    found = {r.doc_id: r for r in quality_rules.rated(docs, references, few, carry=True).collect()}
    names = quality_rules.NAMES
    assert {i: [r[c] for c in names] for i, r in found.items()} == {i: [r[c] for c in names] for i, r in wanted.items()}
    assert all(r.kept for i, r in found.items() if i != 901) and not found[901].kept
    assert found[900].word_distance == 0.0 and all(found[i].text == t and found[i]["rest"].kept == "y" for i, t, _ in rows)


def test_sample_prefers_what_reads_like_the_target(spark, make):
    good = [(i, prose(i, 80)) for i in range(200)]
    junk = [(1000 + i, " ".join(f"zz{i * k % 97}##" for k in range(80))) for i in range(50)]
    docs = make([*good, *junk, (5000, None), (5001, "")])
    labels = spark.createDataFrame(
        [(i, 1) for i in range(0, 200, 2)] + [(1000 + i, 0) for i in range(0, 50, 2)] + [(None, 1), (7, None)], "doc_id long, quality int"
    )
    found = importance.sampled(docs, labels).collect()
    kept = {r.doc_id for r in found if r.kept}
    assert len(found) == 252 and len(kept) == round(0.8 * 252)
    held_good, held_junk = {i for i, _ in good if i % 2}, {i for i, _ in junk if i % 2}
    assert len(kept & held_good) >= 0.95 * len(held_good) and len(kept & held_junk) <= 0.2 * len(held_junk)
    assert {r.log_weight for r in found if r.doc_id in (5000, 5001)} == {0.0}
    least = min(r.sample_key for r in found if r.kept)
    assert all(r.sample_key < least for r in found if not r.kept)
    assert all(r.kept for r in importance.sampled(docs, labels.limit(0)).collect())
    assert importance.sampled(docs.limit(0), labels).collect() == []


def test_kth_largest(spark):
    draw = random.Random(2)
    values = [draw.randrange(-(2**63), 2**63) for _ in range(300)] + [5] * 40 + [-1, 0]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 150, 341, 342):
        assert importance.kth_largest(df, "v", k) == ordered[k - 1]
    assert importance.kth_largest(df, "v", 343) is None


def plain_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        if 16 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def test_strict_spans_of_random_texts():
    draw = random.Random(3)
    parts = ["a", "b.c", "@", ".", "-", "+", " ", "(", ")", "1", "255", "256", "0", "007", "4111 1111 1111 1111",
             "4111-1111-1111-1111", "x@y.zz", "1.2.3.4", "+1 (222) 555-0100", "é", "\n", "_", "%"]
    for _ in range(6000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(0, 14)))
        assert private_data.base_spans(text) == plain_spans(text), text
    for text in HARD:
        assert private_data.base_spans(text or "") == plain_spans(text or "")


def test_long_runs_take_no_longer_than_their_length():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+" * 300_000, "@" * 300_000, "+1" + " " * 300_000, "a@" * 150_000):
        private_data.base_spans(text)
        list(private_data.candidates(text))


def private_rows():
    draw = random.Random(5)
    rows = [(i, t) for i, t in enumerate(HARD)]
    for i in range(400):
        words = prose(i, 40).split()
        kind = i % 4
        number = f"{draw.randrange(200, 999)}) {draw.randrange(200, 999)}-{draw.randrange(1000, 9999)}"
        words[20] = (f"joe{i}@mail{i}.example.com", f"+1 ({number}", f"v{i}.{i}", f"id{draw.randrange(10**9)}x")[kind]
        words[30] = draw.choice(["12 345 678 90x", "20190312-1", "token a1b2c3d4e5f60718", "made at home dot com by"])
        rows.append((100 + i, " ".join(words)))
    return [*rows, (None, "x@y.zz"), (100, "again x@y.zz")]


def test_found_and_redacted(make):
    rows = private_rows()
    docs = make(rows)
    rater = private_data.trained(docs)
    assert set(rater.trees) <= set(private_data.KINDS)
    found = private_data.found(docs, rater, carry=True).collect()
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    for r in found:
        base = {t: plain_spans(t) for t in texts[r.doc_id]}
        digest = {hashlib.sha256(private_data.written(s).encode()).hexdigest(): t for t, s in base.items()}
        text = digest[r.base_sha256]
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(base[text]) <= set(spans) and len(spans) == len(base[text]) + r.n_added
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base[text]) for k in private_data.KINDS]
        assert r.redacted == private_data.redacted(text, spans) and not private_data.base_spans(r.redacted)
        assert r["rest"].kept == "y"
    assert len(found) == len(rows)
    empty = make([])
    assert private_data.found(empty, private_data.trained(empty)).collect() == []


def planted(seed, ways):
    """Prose with strict spans, numbers and phrases of no kind, and spans written in other ways, by place."""
    draw = random.Random(seed)
    rows, wanted = [], {}
    for i in range(1200):
        parts = prose(1000 * seed + i, 30).split(" ")
        a, b, c = (draw.randrange(200, 999) for _ in range(3))
        strict = (f"joe{i}@mail{a}.example.com", f"+1 ({a}) {b}-{c}0", f"10.{a % 250}.{b % 250}.{c % 250}", "word")[i % 4]
        plain = draw.choice([f"in {a}.{b % 10}", f"20{a % 90 + 10}-{b % 9 + 1}-1", f"at home. {a}", f"{a}{b}{c}", f"at {a}.{b} or",
                             f"see {a} {b} {c} {a}", f"version {a % 9}.{b % 9}.{c % 9}", f"look at page.{a}"])
        parts[8], parts[16] = strict, plain
        if i % 3 == 0:
            kind, text = draw.choice(ways(draw, i, a, b, c))
            at = len(" ".join(parts[:24])) + 1
            parts[24:25] = [text, "und"]
            lead = len(text) - len(text.lstrip("abcdefghijklmnopqrstuvwxyz: ")) if kind != "email" else 0
            wanted[i] = (kind, at + lead, at + len(text))
        rows.append((i, " ".join(parts)))
    return rows, wanted


def other_ways(draw, i, a, b, c):
    return [("email", f"ann{i}[at]post{a}[dot]example[dot]org"), ("email", f"ann{i} (at) post{a} dot example dot org"),
            ("ip", f"ip: 10[.]{a % 250}[.]{b % 250}[.]{c % 250}"), ("phone", f"phone {a}-{b}-{c}0"), ("phone", f"tel ({a}) {b}-{c}0")]


def test_trees_find_other_ways_of_writing(make):
    rows, _ = planted(1, other_ways)
    rater = private_data.trained(make(rows))
    assert {"email", "ip", "phone"} <= set(rater.trees)
    rows, wanted = planted(2, other_ways)
    added = {i: rater.added(t, private_data.base_spans(t)) for i, t in rows}
    right = sum(any(k == kind and a < end and start < b for k, a, b in added[i]) for i, (kind, start, end) in wanted.items())
    spans = sum(map(len, added.values()))
    assert right >= 0.8 * len(wanted) and right >= 0.95 * spans, (right, len(wanted), spans)
    for text, kind in (("write to joe at example.com or", "email"), ("joe [at] example [dot] com", "email"), ("555-010-2030", "phone")):
        assert kind in [k for k, _, _ in private_data.candidates(text)]
    assert private_data.redacted("ab x@y.zz cd", [("email", 3, 9), ("ip", 5, 7)]) == "ab [EMAIL] cd"


def test_many_addresses_take_no_longer_than_their_number(make):
    """A log of 6 MB, found and redacted; compared span by span it would take an hour."""
    rows, _ = planted(1, other_ways)
    rater = private_data.trained(make(rows))
    text = "".join(f"10.0.{i % 250}.{i // 250 % 250} user{i}@host.example.com 555-010-{i % 10000:04}\n" for i in range(120_000))
    began = time.process_time()
    base = private_data.base_spans(text)
    every = base + rater.added(text, base)
    assert len(base) == 240_000 and private_data.redacted(text, every).count("[EMAIL]") == 120_000
    assert time.process_time() - began < 60


def test_covers():
    draw = random.Random(8)
    for _ in range(300):
        spans = [("ip", a, a + draw.randrange(1, 9)) for a in (draw.randrange(60) for _ in range(draw.randrange(6)))]
        cover = private_data.Cover(spans)
        for _ in range(20):
            a = draw.randrange(70)
            b = a + draw.randrange(1, 9)
            clash = any(x < b and a < y for _, x, y in spans)
            assert cover.overlaps(a, b) == clash
            if not clash:
                cover.add(a, b)
                spans.append(("ip", a, b))


def test_boosting_learns_and_calibrates():
    draw = np.random.default_rng(1)
    rows = draw.normal(size=(3000, 5))
    labels = (rows[:, 0] > 0.3) & (rows[:, 2] < 0.5)
    model = boosting.fit(rows[:2000], labels[:2000])
    scores = model.scores(rows[2000:])
    assert ((scores > 0.5) == labels[2000:]).mean() > 0.95
    limit = boosting.threshold(scores, labels[2000:], 0.95)
    assert labels[2000:][scores >= limit].mean() >= 0.95
    assert boosting.threshold(np.array([0.9]), np.array([True]), 0.98) == np.inf
    assert len(model.scores(np.zeros((0, 5)))) == 0
