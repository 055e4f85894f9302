"""Each operator against brute force on small texts, and on nulls, blanks, repeats, clashing names and empty tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from scanengine.llm import components, decontaminate, exchange, fingerprint, interpolated_lm, jaccard_join, linediff, mixing, quality, textvec, toxicity, warc, wrapper

WORDS = "ka lo mi ne pu ra si te vo wu xa ye zi ba do".split()
DOCS = "doc_id long, text string, source string, lang string, size string, node string, removed_lines string"


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", low(s))


def shingles(s):
    w = words(s)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def corpus(seed=1, n=60):
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(r.randrange(20, 120))) for _ in range(n // 3)]
    out = []
    for k in range(n):
        w = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            w[r.randrange(len(w))] = r.choice(WORDS) + "!"
        out.append((k, " ".join(w), r.choice(["a", "b", "ä", None]), "en"))
    out += [(n, None, "a", None), (n + 1, "", None, "en"), (n + 2, " \t\n", "b", "en"), (n + 3, "One", "a", "en"), (n + 4, "one", "a", "en"), (n + 5, "Word " * 30_000, "b", "en")]
    out += [out[3], (None, out[4][1], "a", "en"), (None, None, None, None)]
    return [(*row, "1", "2", "3") for row in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


def none_of(docs):
    return docs.where("1 = 0")


def test_words_are_hashed_like_strings():
    texts = ["Ab c  d\x0be", None, "", "x" * 37 + " y", "é É ab", " lead"]
    w = textvec.words(pa.array(texts))
    got = [w.hashes[i:j].tolist() for i, j in zip(w.first, w.first[1:])]
    seen = {}
    for t, hs in zip(texts, got):
        assert len(hs) == len(words(t))
        for x, h in zip(words(t), hs):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (textvec.unpack(textvec.pack(keys)) == keys).all()
    assert textvec.unpack(textvec.pack(keys[:0])).size == 0


def test_mixing_meets_targets(docs):
    rows = mixing.mix(docs, rows_a_bucket=10).collect()
    by = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"] and (r.taken > 0) == (r.first_slot is not None)
        by[r.source].append(r)
    assert len(rows) == docs.count()
    total = sum(r["size"] for r in rows)
    for rs in by.values():
        assert sum(r["size"] for r in rs) == rs[0].source_size
        assert sum(r.taken for r in rs) == round(rs[0].target)
    assert abs(sum(rs[0].target for rs in by.values()) - 1.5 * total) < 1e-6 * total
    assert sorted(map(tuple, mixing.mix(docs, rows_a_bucket=10).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert mixing.mix(none_of(docs)).count() == 0


def test_mixing_follows_its_schedule(docs):
    """Against slots drawn one after another; another step makes another mix.  Blocks of all sources are of like size, but
    not where the step is of no low-discrepancy sequence."""
    texts = [(r.doc_id, r.source, len(words(r.text)), r.text) for r in docs.collect()]
    key = lambda r: hashlib.md5((str(r[0]) if r[0] is not None else hashlib.md5((r[3] or "").encode()).hexdigest()).encode()).hexdigest()
    out = {}
    for step in (mixing.STEP, 889516853, 3):
        got = mixing.mix(docs, slot_words=50, step=step).collect()
        out[step] = sorted((str(r.doc_id), r["size"], r.taken, r.first_slot) for r in got)
        target = {r.source: r.target for r in got}
        sources = sorted(target, key=lambda x: (x is None, x))
        need = [round(target[x]) for x in sources]
        n = -(-sum(need) // 50)
        order = {x: sorted((r for r in texts if r[1] == x), key=lambda r: (key(r), r[0] or 0, r[2])) for x in sources}
        drawn = collections.defaultdict(list)
        for slot in range(n):
            u = slot * step % mixing.PERIOD / mixing.PERIOD
            drawn[next(k for k in range(len(need)) if u < sum(need[: k + 1]) / sum(need))].append(slot)
        for k in range(len(need)):
            if need[k] and not drawn[k]:
                drawn[k] = [min(n - 1, int((sum(need[:k]) / sum(need) + sum(need[: k + 1]) / sum(need)) / 2 * n))]
        taken, first, sizes = collections.Counter(), {}, []
        for k, x in enumerate(sources):
            stream = [p for p, r in enumerate(order[x]) for _ in range(r[2])]
            dealt = iter((stream * 2)[: need[k]])
            for t, slot in enumerate(drawn[k]):
                sizes.append(need[k] // len(drawn[k]) + (t < need[k] % len(drawn[k])))
                for p in itertools.islice(dealt, sizes[-1]):
                    taken[x, p] += 1
                    first.setdefault((x, p), slot)
            assert next(dealt, None) is None
        assert out[step] == sorted((str(r[0]), r[2], taken[x, p], first.get((x, p))) for x in sources for p, r in enumerate(order[x]))
        assert (max(sizes) > 2 * min(sizes)) if step == 3 else (max(sizes) <= 1.5 * min(sizes))
    assert len(set(map(str, out.values()))) == 3


def test_mixing_meets_targets_of_sources_of_every_size(spark):
    """From one word to hundreds of thousands, far below and above a slot; no turn is lost and none is too large."""
    sizes = [1, 1, 2, 7, 50, 100, 100, 100, 3000, 400_000]
    rows = [(100 * k + j, f"s{k:02}", " ".join(["w"] * (n // 4 + (j < n % 4)))) for k, n in enumerate(sizes) for j in range(4)] + [(9999, "empty", "")]
    for slot_words in (4096, 500, 200_000):
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), slot_words=slot_words).collect()
        by = collections.defaultdict(list)
        for r in got:
            by[r.source].append(r)
        assert len(got) == len(rows)
        for rs in by.values():
            assert sum(r.taken for r in rs) == round(rs[0].target) and all(r.taken <= 2 * r["size"] for r in rs)
            assert all((r.taken > 0) == (r.first_slot is not None) for r in rs)


def test_fingerprints_estimate_resemblance(docs):
    d = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in fingerprint.compare_with_edits(d).collect()}
    text = {r.doc_id: r.text or "" for r in d.collect()}
    ids = sorted(text, reverse=True)
    errors = []
    for k, i in enumerate(ids):
        t, nxt = text[i], text[ids[(k + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t), shingles(edited)
        errors.append(got[i].near_edited - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.abs(errors).max() < 0.16 and abs(np.mean(errors)) < 0.03
    same = collections.defaultdict(set)
    for i in ids:
        same[text[i]].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in same.values())
    assert fingerprint.compare_with_edits(none_of(docs)).count() == 0
    assert fingerprint.compare_with_edits(docs).count() == docs.count()


def next_of(spark, rows, buckets):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    real = fingerprint.bucket_by_range
    fingerprint.bucket_by_range = lambda df, c, *_: real(df, c, buckets)
    try:
        return collections.Counter((r.doc_id, r.text, r.next_text) for r in fingerprint.with_next(d, "doc_id", ["text"]).collect())
    finally:
        fingerprint.bucket_by_range = real


def test_next_across_ranges(spark):
    rows = [(i * 3 % 101, f"t{i * 3 % 101}") for i in range(101)] + [(5, "t5")]
    ids = sorted([i for i, _ in rows], reverse=True)
    assert next_of(spark, rows, 7) == collections.Counter((i, f"t{i}", f"t{ids[(k + 1) % len(ids)]}") for k, i in enumerate(ids))


def test_next_of_many_rows_with_one_key_or_none(spark):
    """A third of the rows share a doc_id and a third have none: still a ring, with larger keys first."""
    r = random.Random(2)
    rows = [(r.randrange(40), f"a{k}") for k in range(60)] + [(17, f"b{k}") for k in range(60)] + [(None, f"c{k}") for k in range(60)] + [(17, "b0"), (None, "c0")]
    got = next_of(spark, rows, 5)
    assert sum(got.values()) == len(rows) and collections.Counter(n for _, _, n in got.elements()) == collections.Counter(t for _, t in rows)
    key = lambda i: -1 if i is None else i
    of = collections.defaultdict(set)
    for i, t in rows:
        of[t].add(key(i))
    steps = [(key(i), max(of[n])) for i, _, n in got.elements()]
    assert sum(b > a for a, b in steps) == 1 and all(b <= a or (a == -1 and b == max(k for k, _ in steps)) for a, b in steps)


def brute_components(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        k = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
            root[find(j)] = find(i)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)]


def test_jaccard_join_finds_all_components(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = collections.Counter(map(tuple, jaccard_join.near_duplicates(docs).collect()))
    assert got == collections.Counter(brute_components(rows))
    assert jaccard_join.near_duplicates(none_of(docs)).count() == 0
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None} == {c for i, n, c in got if c is not None}


def test_jaccard_join_on_many_near_copies(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(120)] = f"e{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = collections.Counter(map(tuple, jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == collections.Counter(brute_components(rows))


def test_filters_judge_rows_and_not_ids(spark):
    r = random.Random(12)
    text = lambda n=40: " ".join(r.choice(WORDS) + r.choice(WORDS) + r.choice(WORDS) for _ in range(n))
    a, b, c, leak = text(), text(), text(), text(12)
    near = " ".join(a.split()[:-1])
    schema = "doc_id long, text string, tag int"
    ids = [None, None, None, 7, 7, 7]
    rows = [(i, t, k) for k, (i, t) in enumerate(zip(ids, [a, a, near, b, b, c]))] + [(None, c, 6), (None, None, 7), (None, " ", 8), (None, " ", 9), (9, a, 10), (7, near, 11)]
    kept = sorted((x.doc_id or 0, low(x.text)) for x in jaccard_join.one_of_each(spark.createDataFrame(rows, schema)).collect())
    # a and near link: the smallest id, 7, keeps near; b and c stay once each
    assert kept == sorted([(0, ""), (0, " "), (0, " "), (7, b), (7, c), (7, near)])
    rows = [(None, a, 0), (None, a, 1), (None, near, 2), (None, b, 3)]
    kept = [x.text for x in jaccard_join.one_of_each(spark.createDataFrame(rows, schema)).collect()]
    assert len(kept) == 2 and b in kept
    rows = [(i, t, k) for k, (i, t) in enumerate([(None, a), (None, f"{b} {leak} {c}"), (None, b), (7, leak), (7, c), (8, c)])]
    got = {x.tag for x in decontaminate.cleaned(spark.createDataFrame(rows, schema), spark.createDataFrame([(1, leak)], "item_id long, text string")).collect()}
    assert got == {0, 2, 4, 5}
    junk = lambda: " ".join((r.choice(WORDS) + "!!!").upper() for _ in range(40))
    rows = [(k, junk() if k % 5 == 0 else text(), k) for k in range(300)]
    rows += [(None if k % 2 else 1000, junk() if k % 3 == 0 else text(), k) for k in range(300, 330)] + [(None, None, 330), (1000, " ", 331)]
    labels = spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(300)], "doc_id long, quality int")
    got = {x.tag for x in quality.accepted(spark.createDataFrame(rows, schema), labels).collect()}
    assert got == {k for k in range(300) if k % 5} | {k for k in range(300, 330) if k % 3}


def test_components_of_a_long_path(spark):
    links = spark.range(40).selectExpr("id as a", "id + 1 as b")
    assert {(r.node, r.root) for r in components.components(links).collect()} == {(k, 0) for k in range(1, 41)}


def test_decontamination_against_brute_force(spark, docs):
    r = random.Random(3)
    items = [(k, " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(r.randrange(14, 40)))) for k in range(12)] + [(99, None), (98, ""), (97, "lone pair")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(x[0], x[1]) for x in corpus()]
    planted = []
    for k, (i, t) in enumerate(items[:12]):
        w = t.split()
        if k % 3 == 1:
            w[0] = "changed"
        planted.append((1000 + k, "some words before " + " ".join(w).upper() + " and after " + "it goes on " * 3))
    planted += [(2000, "a lone pair stands here"), (2001, items[0][1] + " between " + items[1][1]), (2002, None)]
    d = spark.createDataFrame(rows + planted, "doc_id long, text string")
    got = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in decontaminate.leaks(d, bench).collect()}
    want = {}
    for i, t in items:
        iw = words(t)
        if not iw:
            continue
        n, k = len(iw), min(5, len(iw))
        a = collections.Counter(tuple(iw[j : j + k]) for j in range(n - k + 1))
        for doc, text in rows + planted:
            dw = words(text)
            for s in range(max(1, len(dw) - n + 1)):
                w = dw[s : s + n]
                b = collections.Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
                shared, whole = sum((a & b).values()), sum((a | b).values())
                if 100 * shared >= 80 * whole:
                    want[(doc, i)] = max(want.get((doc, i), 0), round(shared / whole, 9))
    assert got == want and len(want) >= 14
    left = {x.doc_id for x in decontaminate.cleaned(d, bench).collect()}
    assert left == {x[0] for x in rows + planted} - {x[0] for x in want}
    assert decontaminate.leaks(none_of(docs), bench).count() == 0 and decontaminate.leaks(docs, bench.where("1 = 0")).count() == 0
    narrow = decontaminate.windows(d, decontaminate.items_of(bench, 5), 80, broadcast_rows=0)
    wide = decontaminate.windows(d, decontaminate.items_of(bench, 5), 80)
    assert {tuple(map(str, x)) for x in narrow.collect()} == {tuple(map(str, x)) for x in wide.collect()}


def best_windows(item, text):
    """(similarity, start) of the best window of a text, of equals the last, over all windows as long as the item."""
    a, w = words(item), words(text)
    n, k = len(a), min(5, len(a))
    bag = lambda x: collections.Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
    mine = bag(a)
    out = (0.0, 0)
    for s in range(max(1, len(w) - n + 1)):
        theirs = bag(w[s : s + n])
        shared = sum((mine & theirs).values())
        out = max(out, (shared / max(1, sum((mine | theirs).values())), s))
    return out


def test_decontamination_finds_edited_items_in_any_window(spark):
    """Words changed, left out and put in, and parts that changed places: against all windows.  Prints the recall."""
    r = random.Random(17)
    word = lambda: r.choice(WORDS) + str(r.randrange(300))
    items = [(k, " ".join(word() for _ in range(r.choice([20, 30, 60, 90])))) for k in range(40)]
    items += [(k, " ".join(["no", "yes", "maybe"] * 12 + [word() for _ in range(40)])) for k in range(40, 44)]
    rows = []
    for k, t in items:
        for edits in range(7):
            w = t.split()
            for _ in range(edits):
                at, kind = r.randrange(len(w)), r.randrange(3)
                w[at : at + 1] = [word()] if kind == 0 else [] if kind == 1 else [w[at], word()]
            rows.append((len(rows), " ".join([word() for _ in range(r.randrange(4))] + w + [word() for _ in range(r.randrange(4))])))
        w = t.split()
        rows.append((len(rows), " ".join([word(), *w[len(w) // 2 :], *w[: len(w) // 2], word()])))
    text = dict(items)
    found = {(x.doc_id, x.item_id): (round(x.similarity, 9), x.start) for x in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for k, _ in items:
        for doc, t in rows[8 * k : 8 * k + 8]:
            similarity, start = best_windows(text[k], t)
            if similarity >= 0.8 - 1e-12:
                want[doc, k] = (round(similarity, 9), start)
    recall = len(found.keys() & want.keys()) / len(want)
    print(f"decontamination: recall {recall:.4f} of {len(want)} windows at least 80 percent alike")
    assert recall >= 0.98 and all(found[x] == want[x] for x in found.keys() & want.keys())
    assert any(d % 8 == 7 for d, _ in found)


def test_blocks_within_the_radius_meet(spark):
    r = random.Random(8)
    fps = [r.getrandbits(63) for _ in range(6)]
    near = [(k, x ^ sum(1 << b for b in r.sample(range(63), n))) for k, x in enumerate(fps) for n in (0, 7, 15)]
    items = spark.createDataFrame([(k, 20, 5, x) for k, x in enumerate(fps)], "item_id long, n int, k int, fp long")
    found = spark.createDataFrame([(i, 0, 20, 5, x) for i, (_, x) in enumerate(near)], "doc_id long, start int, n int, k int, fp long")
    got = {(x.doc_id, x.item_id) for x in decontaminate.within_radius(found, items).collect()}
    assert got == {(i, k) for i, (_, x) in enumerate(near) for k, y in enumerate(fps) if bin(x ^ y).count("1") <= 15}


def test_language_model_counts_and_probabilities(docs, spark):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = interpolated_lm.score(docs).collect()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    count = collections.Counter(w for i, t in rows if not out(i) for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for i, t in rows:
        w = [*words(t), None]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[(i, out(i), len(w), sum(count[x] > 0 for x in w), n, round(base, 6))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got) and sum(r.score for r in got) > sum(r.base_score for r in got)
    assert interpolated_lm.score(none_of(docs)).count() == 0


def test_mixture_sums_to_one():
    cells = {((9 * 17 + 2) * 17 + 3) * 17 + 4: (10.0, np.array([1.0, 2.0, 0.5])), ((1 * 17 + 0) * 17 + 3) * 17 + 4: (5.0, np.array([0.0, 1.0, 0.5]))}
    w = interpolated_lm.fit_mixture(cells, 1e-3)
    assert np.allclose(w.sum(1), 1) and (w[0, :2] == 0).all() and (w[1, 0] == 0) and (w[9] > 0).all()


def brute_scores(rows, weights_of):
    """Each row's score by the definition: counts in dictionaries, a token at a time."""
    part = lambda i: {0: 0, 1: 2}.get(zlib.crc32(("" if i is None else str(i)).encode()) % 10, 1)
    texts = [(part(i), ["<", "<", *words(t), ">"]) for i, t in rows]

    def table(kept):
        c = [collections.Counter() for _ in range(3)]
        for p, w in texts:
            if p in kept:
                for k in range(2, len(w)):
                    c[0][w[k]] += 1
                    c[1][w[k - 1], w[k]] += 1
                    c[2][w[k - 2], w[k - 1], w[k]] += 1
        n = sum(p in kept for p, _ in texts)
        return c, n, sum(c[0].values())

    def estimates(found, w, k):
        (c1, c2, c3), n, total = found
        before1 = n if k == 2 else c1[w[k - 1]]
        before2 = n if k == 2 else c2[w[k - 2], w[k - 1]]
        p = [c3[w[k - 2], w[k - 1], w[k]] / before2 if before2 else 0.0, c2[w[k - 1], w[k]] / before1 if before1 else 0.0, c1[w[k]] / max(1, total)]
        return p, min(7, before2.bit_length()) * 8 + min(7, before1.bit_length())

    fit, every = table({1}), table({1, 2})
    uniform = 1 / (len(every[0][0]) + 1)
    held = [estimates(fit, w, k) for p, w in texts if p == 2 for k in range(2, len(w))]
    mixed = weights_of(held, uniform)
    out = []
    for _, w in texts:
        total = 0.0
        for k in range(2, len(w)):
            p, b = estimates(every, w, k)
            total += math.log10(sum(x * y for x, y in zip(mixed[b], [*p, uniform])))
        out.append(total)
    return out


def binned(held, uniform):
    """The weights that fit_mixture() gives for the held-out tokens' estimates, summed by cell."""
    step = lambda x: 0 if x <= 0 else min(1 + math.floor(-2 * math.log10(x)), interpolated_lm.STEPS - 1)
    cells = {}
    for p, b in held:
        cell = b
        for x in p:
            cell = cell * interpolated_lm.STEPS + step(x)
        n, sums = cells.get(cell, (0, np.zeros(3)))
        cells[cell] = (n + 1, sums + np.array(p))
    return interpolated_lm.fit_mixture(cells, uniform)


def test_language_model_scores_by_definition(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = collections.Counter((i, round(x, 6)) for (i, _), x in zip(rows, brute_scores(rows, binned)))
    assert collections.Counter((r.doc_id, round(r.score, 6)) for r in interpolated_lm.score(docs).collect()) == want


def test_binned_estimates_cost_little(docs):
    """Weights from each held-out token's own estimates, without cells, score about the same."""

    def whole(held, uniform):
        return interpolated_lm.fit_mixture({(b * interpolated_lm.STEPS**3 + k % interpolated_lm.STEPS**3): (1, np.array(p)) for k, (p, b) in enumerate(held[: interpolated_lm.STEPS**3])}, uniform)

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    a, b = sum(brute_scores(rows, binned)), sum(brute_scores(rows, whole))
    assert abs(a - b) < 0.01 * abs(b)


def test_exchange_counts_alike_by_every_route(spark):
    r = random.Random(21)
    rows = [(k, " ".join(r.choice(WORDS) + str(r.randrange(200)) for _ in range(r.randrange(60))), k % 3 % 2) for k in range(400)] + [(400, None, 0), (401, "", 1)]
    d = exchange.stable(spark.createDataFrame(rows, "doc_id long, text string, lane int").repartition(5), "documents")
    count = collections.Counter(w for _, t, _ in rows for w in words(t))
    hashed = {int(textvec.words(pa.array([w])).hashes[0]): n for w, n in count.items()}

    lane_count = collections.Counter(w for _, t, k in rows for w in words(t) if k)
    lane_hashed = {int(textvec.words(pa.array([w])).hashes[0]): (count[w], n) for w, n in lane_count.items()}

    def families(table):
        keys, n = np.unique(textvec.words(table["text"]).hashes, return_counts=True)
        return [(keys, [n])]

    def work(table, own, totals):
        t = totals[0]
        return pa.RecordBatch.from_arrays([pa.array(own[0][0].view(np.int64)), pa.array(t[0].astype(np.int64)), pa.array((t[1] if len(t) > 1 else t[0] * 0).astype(np.int64))], ["key", "n", "m"])

    for size, a_bucket, fan, lane in ((1 << 20, 10**6, 4096, None), (600, 40, 4096, None), (600, 40, 4096, "lane"), (600, 40, 3, None), (600, 40, 3, "lane")):
        x = exchange.Exchange(d, families, [64], unit_bytes=size, keys_a_bucket=a_bucket, fan_out=fan, lane=lane)
        assert (fan > 4 or x.inner > 5) and x.totals(0, 0) == (sum(count.values()), len(count))
        got = [(q.key % (1 << 64), q.n) for q in x.each(work, "key long, n long, m long").collect()]
        assert set(got) == set(hashed.items())
        if lane:
            assert x.totals(0, 1) == (sum(lane_count.values()), len(lane_count))
            assert {q.key % (1 << 64): (q.n, q.m) for q in x.each(work, "key long, n long, m long", only=1).collect()} == lane_hashed
    assert exchange.Exchange(d.where("1 = 0"), families, [64]).totals(0, 0) == (0, 0)


def test_line_dedup(spark, docs):
    long = " ".join(f"p{k}" for k in range(30))
    more = " ".join(f"q{k}" for k in range(30))
    rows = [
        (1, f"own one\n{long}\n{more}\nend one"),
        (2, f"own two\n{long.upper()}\n{more}\nend two"),
        (3, f"{more}\nown three\n{long}"),
        (4, "short line\nown four"),
        (5, "short line\nown five"),
        (6, None),
        (7, ""),
        (8, f"own one\n{long}\n{more}\nend one"),
        (None, f"{long}\nno id\n{more}"),
        (9, f"{long}\n\n{more}\nkept"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as removed_lines", "1 as rid")
    got = {r.doc_id: r for r in linediff.dedup_lines(d).collect()}
    assert got[1].text == rows[0][1] and got[1].removed_lines == 0
    assert got[2].text == "own two\nend two" and got[2].removed_lines == 2 and got[2].removed_words == 60
    assert got[3].text == f"{more}\nown three\n{long}"  # blocks of 30 words each are below the least
    assert got[4].text == rows[3][1] and got[5].text == rows[4][1] and got[6].text is None and got[7].text == ""
    assert got[8].text == "" and got[9].text == "\nkept" and got[None].removed_lines == 0
    again = {r.doc_id: r.text for r in linediff.dedup_lines(d, least_words=25).collect()}
    assert again[3] == "own three" and again[None] == "no id"
    assert linediff.dedup_lines(none_of(docs)).count() == 0


def test_common_blocks_keep_firsts_and_find_moves():
    r = random.Random(2)
    for _ in range(200):
        a = [r.randrange(12) for _ in range(r.randrange(20))]
        b = [r.randrange(12) for _ in range(r.randrange(20))]
        gone = linediff.common_blocks(a, b, [1] * len(b), 1)
        assert gone == [j for j, x in enumerate(b) if x in a]


def test_line_dedup_against_all_earlier_documents(spark):
    r = random.Random(11)
    pool = [" ".join(f"{w}{k}" for w in r.choices(WORDS, k=r.choice([1, 3, 7, 12, 25, 45]))) for k in range(30)]
    rows = [(0, "\n".join([pool[0], *pool[5:9]])), (1, "\n".join(pool[1:5]))]  # lines whose first holders differ
    rows += [(k, "\n".join(pool[a : a + 6] + r.choices(pool, k=3) + pool[b : b + 5])) for k in range(2, 60) for a, b in [(r.randrange(25), r.randrange(25))]]
    lines = {k: t.split("\n") for k, t in rows}
    blocks = lambda x, least: {tuple(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1) if sum(len(y.split()) for y in x[i:j]) >= least}
    held, want = set(), {}
    for k, x in sorted(lines.items()):
        gone = {p for i in range(len(x)) for j in range(i + 1, len(x) + 1) if tuple(x[i:j]) in held for p in range(i, j)}
        want[k] = sorted(gone)
        held |= blocks(x, 40)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.pos: sorted(x.removed) for x in linediff.removed_lines(d).collect()}
    assert {k: got.get(k, []) for k in want} == want and any(want.values())


def test_common_blocks_past_copies_of_their_lines():
    assert linediff.common_blocks([1, 9, 2, 8, 3, 7, 1, 2, 3], [1, 2, 3], [20, 20, 20], 40) == [0, 1, 2]


def test_quality_keeps_good_and_rejects_junk(spark):
    r = random.Random(4)
    good = lambda: " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(r.randrange(30, 80)))
    junk = lambda: " ".join((r.choice(WORDS) + "!!!").upper() for _ in range(40)) if r.random() < 0.5 else " ".join(w for w in r.choices(WORDS, k=8) for _ in range(6))
    rows = [(k, junk() if k % 5 == 0 else good()) for k in range(400)] + [(400, None), (401, "  "), (None, good())]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as label", "'z' as n_words")
    labels = spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(0, 300)] + [(5, None), (None, 1), (9999, 1)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.resample(d, labels).collect()}
    assert all(got[k].kept == (k % 5 != 0) for k in range(400))
    assert not got[400].kept and not got[401].kept and got[None].kept
    assert sum(x.kept for x in quality.resample(d, labels, keep=50).collect()) == 50
    assert quality.accepted(d, labels).columns == d.columns
    assert quality.resample(d.where("1 = 0"), labels).count() == 0
    assert quality.resample(d, labels.where("1 = 0")).where("kept").count() == 401


def test_kth_largest(spark):
    v = [1.5, 2.5, 2.5, -1e9, 3.25, 7e8, 0.0]
    d = spark.createDataFrame([(x,) for x in v], "x double")
    assert [quality.kth_largest(d, "x", k, 4) for k in range(1, 8)] == sorted(v, reverse=True)
    assert quality.kth_largest(d, "x", 0) is None


def test_toxicity_learns_words_and_not_groups(spark):
    r = random.Random(6)
    rows, labels = [], []
    for k in range(600):
        w = [r.choice(WORDS) for _ in range(20)]
        toxic = k % 6 == 0
        if toxic:
            w[r.randrange(1, 20)] = r.choice(["blockhead,", "Nitwit", "dolt***"])
        if r.random() < (0.7 if toxic else 0.05):
            w[0] = r.choice(["women", "muslims"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    rows += [(600, None), (601, ""), (602, "women ka lo mi"), (603, "men ka lo mi"), (None, "dolt ka")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score")
    got = {x.doc_id: x for x in toxicity.score(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [k for k in range(600) if got[k].held_out]
    assert held == [k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].predicted == int(k % 6 == 0) for k in held)
    assert got[600].score == got[601].score and got[602].predicted == 0 and abs(got[602].score - got[603].score) < 0.05
    assert toxicity.score(d.where("1 = 0"), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0
    assert {x.score for x in toxicity.score(d, spark.createDataFrame([], "doc_id long, toxic int")).collect()} == {0.5}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies</div><!-- c --><article><h1>Head &amp; tail</h1>
<p>First <b>bold</b>&nbsp;words<br>after<p class="x">Second &#x41;&eacute;<div class="ad">Buy</div><form>Name <input></form>
<section class="comments"><p>Reader says</p></section><ul><li>one<li>two</ul></article>
<aside>Side</aside><footer>Foot</footer></body>"""


def test_html_main_text(spark):
    rows = [(1, "http://h/a", PAGE), (2, "http://h/b", PAGE.replace("First", "Other")), (3, "http://h/c", None), (4, None, ""), (5, "x", "plain <b>text</b> alone"), (1, "http://h/a", PAGE)]
    rows += [(10 + k, f"http://g/{k}", f"<body><div class='menu'>m</div><div id=content><p>t{k}</p><p>u{k}</p></div><div>share this</div></body>") for k in range(6)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as text", "3 as rules")
    got = {x.page_id: x for x in wrapper.extract(d).collect()}
    want = "Head & tail\n\nFirst bold words after\n\nSecond Aé\n\none\n\ntwo"
    assert got[1].text == want and got[1].n_chars == len(want) and got[2].text == want.replace("First", "Other")
    assert got[3].text == "" and got[4].text == "" and got[5].text == "plain text alone"
    assert all(got[10 + k].text == f"t{k}\n\nu{k}" for k in range(6))
    assert wrapper.extract(d).count() == len(rows) and wrapper.extract(d.where("1 = 0")).count() == 0


def test_html_roots_are_chosen_per_page(spark):
    top = "<body><div>x</div>"
    mixed = [f"{top}<article><p>a</p></article></body>", f"{top}<main><p>b</p></main></body>", f"{top}<div class='content'><p>c</p></div></body>", "<body><p>d</p></body>", "<p>e</p>"]
    rows = [(k + 10 * h, url, t) for h, url in enumerate(["http://h/a", None, "no scheme"]) for k, t in enumerate(mixed)]
    got = {x.page_id: x for x in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k + 10 * h].text for h in range(3) for k in range(5)] == list("abcde") * 3 and all(x.n_chars == 1 for x in got.values())


def test_html_drops_only_constant_slots_of_distinct_pages(spark):
    article = "<div>one</div><ul><li>two</li></ul><pre>three</pre><p>four</p>"
    kinds = {
        "a": lambda k: f"<body><article><section>Lead-in <p>own {k}</p></section></article></body>",
        "b": lambda k: f"<body><article>{article}</article></body>",
        "c": lambda k: f"<body>{article}</body>",
        "d": lambda k: f"<body><div>Menu<p>z</p><pre>menu</pre><section>own {k}</section></div></body>",
    }
    rows = [(100 * i + k, f"http://{h}/{k}", f(k)) for i, (h, f) in enumerate(kinds.items()) for k in range(7)]
    got = {x.page_id: x.text for x in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(7):
        assert got[k] == f"Lead-in\n\nown {k}" and got[100 + k] == got[200 + k] == "one\n\ntwo\n\nthree\n\nfour" and got[300 + k] == f"z\n\nown {k}"


def test_html_slots_tell_menus_and_templates(spark):
    links = "<ul><li><a href=a>News</a><li><a href=b>Sport {k}</a><li><a>More</a></ul>"
    kinds = {
        "a": lambda k: f"<body><div>The Daily</div>{links.format(k=k)}<div><p>Text {k} with <a>one link</a></p><ul><li>point <a>x</a> and more words {k}</li><li>two</li></ul></div></body>",
        "b": lambda k: f"<body><article>{links.format(k=k)}<p>kept {k}</p></article></body>",
    }
    rows = [(100 * i + k, f"http://{h}/{k}", f(k)) for i, (h, f) in enumerate(kinds.items()) for k in range(3)]
    got = {x.page_id: x.text for x in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(3):
        assert got[k] == f"Text {k} with one link\n\npoint x and more words {k}\n\ntwo"
        assert got[100 + k] == f"kept {k}"  # a menu is none of the article's text, wherever it stands


def texts_of(spark, rows):
    return {x.page_id: x.text for x in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_copies_with_different_menus_keep_their_article(spark):
    body = "<div>" + "The same article, word for word. " * 20 + "</div>"
    rows = [(k, f"http://h/{k}", f"<body><div>Menu {k} of this page</div>{body}</body>") for k in range(2)] + [(9, "http://alone/", f"<body><div>Menu</div>{body}</body>")]
    got = texts_of(spark, rows)
    want = " ".join(["The same article, word for word."] * 20)
    assert all(got[k].endswith(want) for k in (0, 1, 9))


def test_html_names_are_read_as_a_whole(spark):
    kept = ["data-grid='search'", "data-uid='comment-12'", "data-class=ad", "class='comment-policy-free story'", "class='content no-comments'", "id='ad-hoc'", "class='story widget'", "data-hidden='true'", "title='x hidden y'", "class=menus-of-the-world"]
    gone = ["class='ad'", "class='site-footer'", "id=comments", "class='postComments'", "role=navigation", "class='cookie-banner x'", "hidden", "aria-hidden='true'", "style='display: none'", "class='ad-slot-3'"]
    page = lambda a: f"<body><article><p>before</p><div {a}><p>the text</p></div><p>after</p></article></body>"
    rows = [(k, f"http://h{k}/", page(a)) for k, a in enumerate([*kept, *gone])]
    rows += [(100 + k, f"http://g{k}/", f"<body><div {a}><p>the text</p></div></body>") for k, a in enumerate(kept)]
    got = texts_of(spark, rows)
    for k in range(len(kept)):
        assert got[k] == "before\n\nthe text\n\nafter" and got[100 + k] == "the text", kept[k]
    for k in range(len(kept), len(rows) - len(kept)):
        assert got[k] == "before\n\nafter", rows[k]


def test_html_of_generated_hosts(spark):
    """Pages made of known parts: what an article holds comes back, block by block, and nothing else; with article elements, with
    main ones, with names, and with plain ones whose menus and footers only the host's other pages tell."""
    r = random.Random(17)
    said = lambda n: " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))
    rows, want = [], {}
    for h in range(24):
        kind = h % 4
        links = [said(1) for _ in range(5)]
        foot, brand = said(4), said(3)
        for k in range(5):
            blocks = [(r.choice(["p", "p", "h2", "blockquote"]), said(r.randrange(8, 40))) for _ in range(r.randrange(3, 9))]
            inner = "".join(f"<{t}>{x}</{t}>" if r.random() < 0.8 else f"<{t}>\n {x.replace(' ', '  ', 1)}<!-- note --></{t}>" for t, x in blocks)
            menu = "".join(f"<li><a href=/{k}>{x}</a></li>" for x in links + [said(1)])
            opened, closed = [("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post-body'>", "</div>"), ("<section>", "</section>")][kind]
            top = f"<div>{brand}</div><ul>{menu}</ul>" if kind == 3 else f"<header>{brand}</header><nav><ul>{menu}</ul></nav>"
            end = f"<div>{foot}</div>" if kind == 3 else f"<footer>{foot}</footer><div class='comments'><p>{said(20)}</p></div>"
            i = 100 * h + k
            rows.append((i, f"http://host{h}.example/{k}", f"<html><head><title>{said(3)}</title></head><body>{top}{opened}{inner}{closed}{end}<script>x</script></body></html>"))
            want[i] = "\n\n".join(x for _, x in blocks)
    assert texts_of(spark, rows) == want


def test_shingles_are_ordered_by_documents_at_every_count():
    n = np.unique(np.concatenate([np.arange(5000), 2 ** np.arange(40), 2 ** np.arange(40) - 1, np.random.default_rng(2).integers(1, 2**40, 5000)])).astype(np.uint64)
    g = jaccard_join.grade(n).astype(np.int64)
    assert (np.diff(g) >= 0).all() and g.max() < 2048 and (g[n < 1024] == n[n < 1024]).all()
    far = n[n >= 1024].astype(np.float64)
    # counts that differ by more than a thirty-second part have different grades
    at = np.searchsorted(far, far * 1.07)
    ok = at < len(far)
    assert (g[n >= 1024][at[ok]] > g[n >= 1024][ok]).all()


def test_lists_of_children_are_aligned_in_bounds():
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.choice("abcdef") for _ in range(r.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = wrapper.common_run(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:])) and len(got) == best[-1][-1]
    long = [f"x{k}" for k in range(20_000)]
    moved = [*long[:5000], "new", *long[5000:12_000], *long[12_500:]]
    assert len(wrapper.common_run(long, moved)) == 19_500
    assert wrapper.common_run([f"a{k}" for k in range(20_000)], [f"b{k}" for k in range(20_000)]) == []
    half = ["p", "q"] * 5000
    assert wrapper.common_run(half, ["q", *half]) != [] and wrapper.common_run(half, half) == [(k, k) for k in range(10_000)]


def test_html_deep_elements_close_only_themselves():
    def text(page):
        h = wrapper.Host()
        h.page(page)
        return wrapper.main_text(page, wrapper.rules_of(h.wrapper, h.places, h.pages, len(h.known)))

    deep = lambda x, n=130: "<div>" * n + x + "</div>" * n
    assert text(f"<body><div><article><p>a</p>{deep('b<p>c</p><nav>n</nav>d')}<p>e</p></article></div><p>f</p></body>") == "a\n\nb\n\nc\n\nd\n\ne"
    assert text(f"<body>{deep('<article><p>a</p></article>')}<p>b</p></body>") == "a\n\nb"
    assert text(f"<article>{deep('<div>a', 300)}</div>" + "</p></i>" * 9 + "<p>b<i>c</i></article>d") == "a\n\nbc"


def test_wrappers_generalise():
    trees = ["<div><h2>a</h2><p>x</p><p>y</p></div>", "<div><p>x</p></div>", "<div><h2>b</h2><p>x</p><hr><p>z</p><hr><p>q</p><hr></div>"]
    w = None
    for t in trees:
        one = wrapper.wrap(wrapper.parse(t))
        w = one if w is None else wrapper.merged(w, one)
    text = wrapper.expression(w)
    assert "<h2> #TEXT </h2>?" in text and "<p> #TEXT </p>*" in text and "(<p> #TEXT </p> <hr></hr>)*" in text
    wrapper.main_text("<" * 2000 + "<p " + "a='" * 500 + "<div>" * 500 + "deep", {"roots": ["#root"], "dropped": []})


def test_warc_round_trip(spark):
    big, small = "Ä" * 700, "tiny"
    r = random.Random(1)
    noise = "".join(chr(r.randrange(32, 0x2FFF)) for _ in range(60_000))
    rows = [(1, "u1", big), (2, "u2", big), (3, "u\r\n3", big), (4, "u4", small), (5, None, small), (6, "u6", None), (7, "u7", noise), (8, "u8", "\r\n\r\nWARC/1.0\r\n" * 200), (None, "u9", "x" * 2000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as payload").repartition(2)
    got = {x.page_id: x for x in warc.round_trip(d, split_bytes=700).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        data = (h or "").encode()
        x = got[i]
        assert x.payload_length == len(data) and x.payload_digest == hashlib.sha1(data).hexdigest()
        assert (x.record_type, x.refers_to) == (("revisit", 3) if i in (1, 2) else ("response", None))
        assert x.record_type == "revisit" or bytes(x.payload) == data
    assert warc.round_trip(d.where("1 = 0")).count() == 0


def test_one_of_repeated_pages_is_the_response(spark):
    big, edge, short = "B" * 3000, "e" * 1000, "s" * 999
    rows = [(1, "u", big), (1, "u", big), (1, "u", big), (0, "z", big), (2, "a", edge), (2, "b", edge), (2, None, edge), (3, "u", short), (3, "u", short), (None, "u", "n" * 2000), (None, "u", "n" * 2000)]
    rows += [(4, "long", "lo ng " * 700_000)] * 2
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = collections.Counter((x.page_id, x.record_type, x.refers_to) for x in warc.round_trip(d, split_bytes=3000).select("page_id", "record_type", "refers_to").collect())
    assert got == {(1, "response", None): 1, (1, "revisit", 1): 2, (0, "revisit", 1): 1, (2, "response", None): 1, (2, "revisit", 2): 2, (3, "response", None): 2, (None, "response", None): 1, (None, "revisit", None): 1, (4, "response", None): 1, (4, "revisit", 4): 1}


def test_splits_own_each_record_once(tmp_path):
    inner = warc.record_bytes("response", "in", "u", b"inner", None)
    data, starts = b"", []
    for k in range(20):
        starts.append(len(data))
        data += warc.record_bytes("response", f"r{k}", "u", b"p" * (k * 37) + inner * (k % 3), None)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"garbage\x1f\x8b\x08 not gzip" + data)
    shift = len(b"garbage\x1f\x8b\x08 not gzip")
    for width in (50, 333, 5000, 10**6):
        got = []
        for s in range(0, len(data) + shift, width):
            with path.open("rb") as f:
                got += [at for at, _ in warc.records_in(f, len(data) + shift, s, min(s + width, len(data) + shift), 64)]
        assert got == [s + shift for s in starts]


def test_line_dedup_of_long_and_repeated_rows(spark):
    r = random.Random(23)
    line = lambda: " ".join(r.choice(WORDS) + str(r.randrange(10**6)) for _ in range(12))
    block = "\n".join(line() for _ in range(5))
    long = "\n".join(line() for _ in range(20_000))
    rows = [(1, long), (2, f"{line()}\n{block}"), (3, f"{block}\nown three"), (3, f"{block}\nown three"), (3, f"other text\n{block}"), (4, long + "\nmore"), (5, "x " * 50_000), (6, "x " * 50_000 + "y")]
    got = [(x.doc_id, x.text, x.removed_lines) for x in linediff.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(rows) and (1, long, 0) in got and (4, "more", 20_000) in got
    assert sorted(t for i, t, _ in got if i == 3) == ["other text", "own three", "own three"]
    assert sum(n for i, _, n in got if i in (2, 5, 6)) == 0


def test_html_of_long_deep_and_repeated_pages(spark):
    many = "".join(f"<p>p{k}</p>" for k in range(20_000))
    rows = [(1, "http://h/1", f"<article>{many}</article>"), (2, "http://h/2", "<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000), (3, "http://h/3", "<p>" + "word " * 200_000 + "</p>")]
    rows += [(4, "http://h/4", "<body><div>same</div><p>same</p></body>")] * 7
    got = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = collections.defaultdict(set)
    for x in got:
        by[x.page_id].add(x.text)
    assert len(got) == 10 and by[1] == {"\n\n".join(f"p{k}" for k in range(20_000))} and by[2] == {"deep"} and by[3] == {" ".join(["word"] * 200_000)} and by[4] == {"same\n\nsame"}


def test_toxicity_fit_by_plain_loops():
    """The penalised fit, the swaps and the scores, against loops over rows and terms."""
    r = random.Random(12)
    texts = [(" ".join(r.choice(WORDS) for _ in range(12)) + r.choice([" women", " men", " women men", ""]) + (" idiot" if y else ""), y) for y in [int(r.random() < 0.3) for _ in range(80)]]
    vocabulary = sorted({w for t, _ in texts for w in t.split()})
    column_of = {toxicity.bin_of([w])[0]: k for k, w in enumerate(vocabulary)}
    columns = np.full(toxicity.BINS, -1, np.int64)
    columns[list(column_of)] = list(column_of.values())
    bins, doc, n = toxicity.word_bins(pa.array([t for t, _ in texts]))
    rows, cols = toxicity.presence(bins, doc, n, columns)
    held = [set(t.split()) for t, _ in texts]
    found = [(vocabulary.index("ka"), vocabulary.index("lo"))]
    a, b, many = toxicity.counterfactuals(rows, cols, column_of, found)
    want = {(x, y): sum(x in h and y not in h for h in held) for x, y in [("women", "men"), ("men", "women"), ("ka", "lo")]}
    assert {(vocabulary[i], vocabulary[j]): k for i, j, k in zip(a, b, many)} == {k: v for k, v in want.items() if v}
    y = np.array([y for _, y in texts], float)
    got, bias = toxicity.fit_weights(rows, cols, y, len(vocabulary), (a, b, many), steps=25)
    w, c, m, v = {x: 0.0 for x in vocabulary}, 0.0, collections.Counter(), collections.Counter()
    for t in range(1, 26):
        slope = collections.Counter({x: 0.1 * w[x] / len(texts) for x in vocabulary})
        for h, label in zip(held, y):
            off = 1 / (1 + math.exp(-(c + sum(w[x] for x in h)))) - label
            for x in h:
                slope[x] += off / len(texts)
            slope[None] += off / len(texts)
        for (x, z), k in want.items():
            for _ in range(k):
                slope[z] += 20.0 * (w[z] - w[x]) / sum(want.values())
                slope[x] -= 20.0 * (w[z] - w[x]) / sum(want.values())
        for x in [*vocabulary, None]:
            m[x], v[x] = 0.9 * m[x] + 0.1 * slope[x], 0.99 * v[x] + 0.01 * slope[x] ** 2
            step = 0.1 * (m[x] / (1 - 0.9**t)) / (math.sqrt(v[x] / (1 - 0.99**t)) + 1e-8)
            if x is None:
                c -= step
            else:
                w[x] -= step
    assert np.allclose(got, [w[x] for x in vocabulary], atol=1e-6) and abs(bias - c) < 1e-6
    model = toxicity.Model(columns, got, bias)
    scores = model.score(pa.array([*[t for t, _ in texts], "", None, "unknown words"]))
    assert np.allclose(scores, [1 / (1 + math.exp(-(c + sum(w.get(x, 0) for x in h)))) for h in [*held, (), (), ()]], atol=1e-6)


def test_toxicity_finds_terms_in_the_texts(spark):
    """Two groups that no list names, one of which the labelled insults name more often: both are found, as of one kind, and
    the penalty draws their weights together."""
    r = random.Random(5)
    rows, labels = [], []
    for k in range(3000):
        toxic = r.random() < 0.25
        group = "zorbs" if r.random() < (0.53 if toxic else 0.5) else "quems"
        rows.append((k, " ".join(["the", group, "met", "again", "at", "noon"] + [r.choice(WORDS) + r.choice(WORDS) for _ in range(8)] + (["vermin"] if toxic else []))))
        labels.append((k, int(toxic)))
    rows += [(5000 + k, " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(8))) for k in range(1500)]
    labels += [(5000 + k, 0 if k % 4 else 1) for k in range(1500)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    weight = lambda m, w: m.weights[m.columns[toxicity.bin_of([w])[0]]]
    fair, plain = toxicity.fit(docs, known), toxicity.fit(docs, known, fairness=0.0)
    assert fair.swaps > 1000
    apart = [abs(weight(m, "zorbs") - weight(m, "quems")) for m in (fair, plain)]
    assert apart[0] < apart[1] / 2 and weight(fair, "vermin") > 2


def test_toxicity_swaps_on_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fair, plain = (toxicity.fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), fairness=f) for f in (10.0, 0.0))
    texts = pa.array([x.text for x in docs.select("text").limit(300).collect()], pa.string())
    assert fair.swaps > 0 and np.abs(fair.score(texts) - plain.score(texts)).max() > 1e-3


def test_classifiers_on_long_and_repeated_rows(spark):
    r = random.Random(31)
    good = lambda n=40: " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))
    bad = lambda n=40: " ".join((r.choice(WORDS) + "!!!").upper() for _ in range(n)) + " idiot"
    rows = [(k, bad() if k % 4 == 0 else good()) for k in range(200)] + [(300, good(200_000)), (301, bad(200_000))]
    rows += [(0, bad())] * 500 + [(1, good())] * 500 + [(None, good()), (None, bad()), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0), int(k % 4 == 0)) for k in range(200)], "doc_id long, quality int, toxic int")
    is_bad = {t: "idiot" in t for _, t in rows if t}
    kept = {x.text for x in quality.accepted(d, labels.select("doc_id", "quality")).collect()}
    assert kept == {t for t, b in is_bad.items() if not b}
    whole = quality.resample(d, labels.select("doc_id", "quality"), keep=30, sharpness=None).where("kept").collect()
    assert 300 in {x.doc_id for x in whole} and 300 not in {x.doc_id for x in quality.resample(d, labels.select("doc_id", "quality"), keep=1).where("kept").collect()} | {None}
    scored = toxicity.score(d, labels.select("doc_id", "toxic")).collect()
    assert len(scored) == len(rows) and {x.doc_id: x.predicted for x in scored if x.doc_id in (300, 301)} == {300: 0, 301: 1}
    assert collections.Counter(x.predicted for x in scored if x.doc_id in (0, 1)) == {1: 501, 0: 501}
