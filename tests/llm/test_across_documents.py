"""Operators that compare documents, against plain models."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import pytest

from pageloom.llm import components, context_tree, line_dedup, ngram_join, substring_dedup
from tests.llm.cases import corpus, frame, lower, words


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (10, 11), (11, 12), (12, 10), (20, 21)] + [(100, 100 + i) for i in range(1, 50)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 7)) and all(got[i] == 10 for i in (10, 11, 12)) and got[21] == 20 and all(got[100 + i] == 100 for i in range(50))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _clusters(rows, k, percent):
    big = 1 << 62
    sets = []
    for i, t in rows:
        w = words(lower(t))
        sets.append((big if i is None else i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    least = {}
    for a in range(len(sets)):
        least[find(a)] = min(least.get(find(a), big), sets[a][0])
    null = lambda v: None if v == big else v
    return Counter((null(i), len(s), null(least[find(a)])) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_ngram_join(spark, monkeypatch, k, percent):
    rows = corpus()
    want = _clusters(rows, k, percent)
    for small in (256, 8):
        monkeypatch.setattr(ngram_join, "SMALL", small)
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.clustered(frame(spark, rows), k, percent).collect())
        assert got == want


def test_regions_miss_nothing():
    """A large region of near copies and strangers: every pair that links is a candidate."""
    import random

    import numpy as np

    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(400)]
    sets = []
    for i in range(700):
        x = set(base[:50])
        x |= set(base[50:150]) - set(r.sample(base[50:150], r.randint(0, 25))) if i % 2 else {r.getrandbits(64) for _ in range(r.randint(20, 120))}
        sets.append(np.array(sorted(x), np.uint64))
    region = ngram_join._Region(np.array([len(x) for x in sets]), [ngram_join._sketch(x) for x in sets], 85)
    found = {(min(a, b), max(a, b)) for p in region.pairs(np.arange(700)) for a, b in zip(p[0].tolist(), p[1].tolist())}
    for a in range(0, 700, 3):
        for b in range(a + 1, 700):
            i = len(np.intersect1d(sets[a], sets[b]))
            if 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
                assert (a, b) in found


def test_survivors(spark):
    text = " ".join(f"w{i}" for i in range(60))
    out = ngram_join.survivors(frame(spark, [(5, text), (3, text), (9, text + " x"), (4, "alone in here"), (None, text), (6, None)]))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 3), (False, 4), (False, 6), (True, 0)]
    assert ngram_join.clustered(frame(spark, [])).count() == 0


def test_survivors_by_row(spark):
    """Repeated rows, and ids that stand at several texts: one row of each group stays, other texts of an id are left alone."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, one), (1, one), (2, one + " x"), (2, two), (3, three), (3, three + " y"), (4, None), (4, None), (5, ""), (5, "")]
    out = ngram_join.survivors(frame(spark, rows).withColumnRenamed("_block", "_row"))
    assert "_row" in out.columns
    got = sorted((r.doc_id, r.text or "") for r in out.collect())
    assert got in [sorted([(1, one), (2, two), (3, t), (4, ""), (4, ""), (5, ""), (5, "")]) for t in (three, three + " y")]
    assert ngram_join.survivors(frame(spark, [])).count() == 0


def test_substring_dedup_equals_sql(spark):
    rows = [(i, t) for i, t in corpus() if i is not None]
    docs = frame(spark, rows)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.deduplicated(docs, block_docs=7).collect())
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841
    want = Counter(duckdb.sql(substring_dedup.ORACLE_SQL).fetchall())
    assert got == want


def test_levels(spark):
    rows = [(1, "a b c d e f g h"), (2, "z b c d e f g h"), (None, "b c d e f g h"), (4, None), (5, "")]
    assert [tuple(r) for r in substring_dedup.longest_repeats(frame(spark, rows), 2).collect()] == [(2, 6), (4, 4)]
    kept = {r.doc_id: (r.kept, r.n_removed) for r in substring_dedup.deduplicated(frame(spark, rows), 3).collect()}
    assert kept == {1: ("a b c d e f g h", 0), 2: ("z", 7), None: ("", 7), 4: ("", 0), 5: ("", 0)}
    assert substring_dedup.deduplicated(frame(spark, [])).count() == 0


def _line_model(rows, common):
    big = 1 << 62
    docs = [(big if i is None else i, (t or "").split("\n") if t else []) for i, t in rows]
    trim = lambda x: x.strip(" \t\n\r\f\v")
    first, where = {}, {}
    for i, ls in docs:
        for x in ls:
            if len(words(x)) >= line_dedup.LINE_WORDS:
                first[trim(x)] = min(first.get(trim(x), big), i)
                where.setdefault(trim(x), set()).add(i)
    out = Counter()
    for i, ls in docs:
        lines = [trim(x) for x in ls]
        shared = [x for x in lines if x in first and first[x] < i]
        rare = [x for x in shared if len(where[x]) <= common]
        gone = set()
        for p in {first[x] for x in (rare or shared)}:
            for other in [[trim(x) for x in ol] for j, ol in docs if j == p]:
                block, before = [], (-9, -9)
                for a, b in [*line_dedup.patience(other, lines), (-5, -5)]:
                    if (a, b) != (before[0] + 1, before[1] + 1):
                        if sum(len(words(lines[k])) for k in block) >= line_dedup.BLOCK_WORDS:
                            gone.update(block)
                        block = []
                    block.append(b)
                    before = (a, b)
        kept = "\n".join(x for k, x in enumerate(ls) if k not in gone)
        out[None if i == big else i, len(ls) - (ls[-1:] == [""]), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_line_dedup(spark):
    rows = corpus() + [(500, "x y z\n\nfirst long line of some text here\nx y z\n"), (501, "first long line of some text here\n\nother thing to say\n  x y z"), (502, "first long line of some text here\nx y z")]
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.removals(frame(spark, rows), block_docs=9).collect())
    assert got == _line_model(rows, 2)
    new = {r.doc_id: r for r in line_dedup.deduplicated(frame(spark, rows)).collect()}
    assert 30 not in new and new[500].text == rows[-3][1] and new[501].n_chars == len(new[501].text) and None not in {r.sid for r in new.values()}
    assert line_dedup.removals(frame(spark, [])).count() == 0


def _removed_by_every_earlier(rows):
    """doc_id to its kept lines when it is compared with every earlier document."""
    out = {}
    for i, text in rows:
        lines, gone = text.split("\n"), set()
        for j, other in rows:
            block, before = [], (-9, -9)
            for a, b in [*(line_dedup.patience(other.split("\n"), lines) if j < i else ()), (-5, -5)]:
                if (a, b) != (before[0] + 1, before[1] + 1):
                    if sum(len(words(lines[k])) for k in block) >= line_dedup.BLOCK_WORDS:
                        gone.update(block)
                    block = []
                block.append(b)
                before = (a, b)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_common_lines_name_partners(spark):
    """A hot line goes also where a rare line is shared with a document that doesn't hold it."""
    hot, rare = "this hot line stands in a third of all", "a rare line"
    rows = [(1, f"{hot}\nbegin"), (2, f"{rare}\nno hot line here"), (3, f"{rare}\n{hot}\nown words here")]
    rows += [(i, f"only here {i}\n{hot}" if i % 3 else f"nothing of it {i}\nat all") for i in range(4, 40)]
    want = _removed_by_every_earlier(rows)
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(frame(spark, rows), block_docs=9).collect()}
    assert want[3] == f"{rare}\nown words here" and got == want


def test_blocks_name_the_document_that_holds_them_whole(spark):
    """A block of short lines goes though each of its lines stands first in another document."""
    import random

    r = random.Random(4)
    short = [f"short {i} line" for i in range(9)]
    rows = [(i, f"own {i}\n{x}\nend {i}") for i, x in enumerate(short)]
    rows += [(20, "\n".join(["head", *short[:3], "", *short[3:6], "tail"])), (21, "\n".join(["before", *short[:3], "", "after"])), (22, "\n".join(["1", "2", "", *short[3:6]])), (23, "\n".join([*short[1:3], "", short[3]]))]
    blocks = [short[i : i + 3] for i in (0, 3, 6)]
    rows += [(i, "\n".join(y for k in sorted(r.sample(range(3), 2)) for y in [f"own {i} {k}", *blocks[k]])) for i in range(30, 60)]
    want = _removed_by_every_earlier(rows)
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(frame(spark, rows), block_docs=9).collect()}
    assert want[21] == "before\nafter" and want[22] == "1\n2"
    assert got == {i: x for i, x in want.items() if x.strip()}


def test_seeds_are_the_shortest_runs():
    """The runs of each document and no other, by counting words."""
    import numpy as np
    import pyarrow as pa

    from pageloom.llm import tokens

    texts = ["a b c\n\nd e f\ng h i\nj", "", "one two three four five six seven eight\nx\n\n", "p\nq", "a b c\n\nd e f\ng h i\nk", "\n".join("t u" for _ in range(9))]
    (s,) = tokens.slices(pa.array(texts))
    x = line_dedup.Lines(s)
    h, row = line_dedup.seeds(x)
    for i in range(len(texts)):
        lines = x.hash[x.first[i] : x.first[i + 1]].tolist()
        n = x.words[x.first[i] : x.first[i + 1]].tolist()
        runs = [(a, b) for a in range(len(n)) for b in range(a + 1, len(n) + 1) if sum(n[a:b]) >= line_dedup.BLOCK_WORDS]
        least = {(a, min(b for p, b in runs if p == a)) for a, _ in runs} | {(max(a for a, q in runs if q == b), b) for _, b in runs}
        want = {tuple(lines[a:b]) for a, b in least if b - a > 1} | {(v,) for v, w in zip(lines, n) if w >= line_dedup.LINE_WORDS}
        assert len(want) == len(np.unique(h[row == i]))
    assert len(np.intersect1d(h[row == 0], h[row == 4])) == len(np.unique(h[row == 0])) - 1  # all but those with the last line


def test_patience():
    x, y = list("abcXdefYg"), list("abcdeZfg")
    got = line_dedup.patience(x, y)
    assert [(x[i], y[j]) for i, j in got] == [(c, c) for c in "abcdefg"]
    assert line_dedup.patience([], [1]) == []


def _ctw(train, depth, text):
    """Context-tree weighting by recursion over dictionaries: log10 probability of text given training streams."""
    counts = {}

    def steps(stream):
        b = bytes([10]) * depth + stream
        for k in range(depth, len(b)):
            for bit in range(8):
                yield (b[k] >> (8 - bit)) | (1 << bit), b[k - depth : k][::-1], (b[k] >> (7 - bit)) & 1

    for s in train:
        for path, context, bit in steps(s):
            for d in range(depth + 1):
                counts.setdefault((path, context[:d]), [0, 0])[bit] += 1
    kids = {}
    for path, context in counts:
        if context:
            kids.setdefault((path, context[:-1]), []).append((path, context))
    kt = lambda c: math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(sum(c) + 1) - math.log(math.pi)
    memo = {}

    def weighted(node):
        if node not in memo:
            own = kt(counts[node])
            if len(node[1]) == depth:
                memo[node] = own
            else:
                s = sum(weighted(k) for k in kids[node])
                m = max(own, s)
                memo[node] = m + math.log(math.exp(own - m) + math.exp(s - m)) - math.log(2)
        return memo[node]

    total = 0.0
    for path, context, bit in steps(text):
        p = 0.5
        for d in range(depth, -1, -1):
            node = (path, context[:d])
            if node not in counts:
                continue
            c = counts[node]
            own = (c[bit] + 0.5) / (sum(c) + 1)
            stop = 1.0 if d == depth else math.exp(kt(c) - math.log(2) - weighted(node))
            p = stop * own + (1 - stop) * p
        total += math.log10(p)
    return total


def test_context_tree(spark):
    rows = [(i, t) for i, t in corpus() if t is None or len(t) < 3000][:40] + [(None, "Some Words"), (2, "again two")]
    got = context_tree.scored(frame(spark, rows), depth=3, block_docs=9).collect()
    stream = lambda t: " ".join(words(lower(t))).encode() + b"\n"
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter(x for t in train for x in [*words(lower(t)), "\n"])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in rows:
        w = [*words(lower(t)), "\n"]
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        held = None if i is None else zlib.crc32(str(i).encode()) % 5 == 1
        want[i, held, len(w), sum(x in count for x in w), n, round(base, 4), round(_ctw([stream(x) for x in train], 3, stream(t)), 2)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 2)) for r in got) == want
    assert context_tree.scored(frame(spark, []), depth=3).count() == 0
    alone = context_tree.scored(frame(spark, [(0, "a b")]), depth=3).first()  # in or out of training, it is scored
    assert alone.n_bytes == 4 and alone.score < 0


def _common_blocks(x, y):
    """Blocks of consecutive equal lines by a plain longest-common-subsequence table, nothing of the module's own."""
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    blocks, before = [], (-9, -9)
    while i < len(x) and j < len(y):
        if x[i] == y[j] and best[i][j] == best[i + 1][j + 1] + 1:
            if (i, j) != (before[0] + 1, before[1] + 1):
                blocks.append([])
            blocks[-1].append(j)
            before = (i, j)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return blocks


def test_line_dedup_recall_of_all_pairs(spark):
    """Of the lines that alignment with every earlier document removes, by another diff, at least nine tenths go, and hardly any other."""
    import random

    r = random.Random(8)
    pool = [" ".join(r.choices("abcdefghijklmnopqrst", k=r.randint(2, 9))) for _ in range(60)]
    texts = [[r.choice(pool) if r.random() < 0.5 else f"own {i} {k} {r.random()}" for k in range(r.randint(2, 14))] for i in range(90)]
    texts += [texts[r.randrange(90)][: r.randint(3, 12)] + ["", *texts[r.randrange(90)]] for _ in range(30)]
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    want = {}
    for i, t in rows:
        lines = t.split("\n")
        gone = {j for k in range(i) for b in _common_blocks(texts[k], lines) if sum(len(words(lines[j])) for j in b) >= line_dedup.BLOCK_WORDS for j in b}
        want[i] = gone
    got = {}
    for x in line_dedup.deduplicated(frame(spark, rows), block_docs=9).collect():
        got[x.doc_id] = Counter(x.text.split("\n"))
    caught = total = over = 0
    for i, t in rows:
        lines = t.split("\n")
        kept, must = got.get(i, Counter()), Counter(lines[j] for j in want[i])
        removed = Counter(lines) - kept
        total += sum(must.values())
        caught += sum((removed & must).values())
        over += sum((removed - must).values())
    assert total > 100 and caught >= 0.9 * total and over <= 0.1 * total


def test_a_copy_goes_whole_though_its_lines_stand_first_elsewhere(spark):
    a, b = "one two three four five", "six seven eight nine ten"
    rows = [(1, a), (2, b), (3, f"{a}\n{b}"), (4, f"{a}\n{b}"), (None, f"{a}\n{b}"), (None, b)]
    got = sorted(((r.doc_id or 99), r.n_removed) for r in line_dedup.removals(frame(spark, rows), block_docs=2).collect())
    assert got == [(1, 0), (2, 0), (3, 0), (4, 2), (99, 0), (99, 2)]


def test_a_region_of_near_copies_is_quick():
    """8,000 near copies that share 20 regions, some of them too far from each other: connected, each pair compared once."""
    import time

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    base = r.integers(0, 2**64, 200, dtype=np.uint64)
    sets = []
    for _ in range(8000):
        x, k = base.copy(), r.integers(0, 11)
        x[20 + r.choice(180, k, replace=False)] = r.integers(0, 2**64, k, dtype=np.uint64)
        sets.append(np.unique(x))
    sid = np.array([ngram_join._sid(x) for x in sets])
    members = pa.table({"h": np.repeat(base[:20].view(np.int64), 8000), "sid": np.tile(sid, 20)})
    sketches = pa.table({"own": sid, "n": [len(x) for x in sets], "sketch": pa.array([ngram_join._sketch(x) for x in sets], pa.binary())})
    t = time.time()
    found = ngram_join._forest(85)(members, sketches)
    assert time.time() - t < 5
    assert found.num_rows == len(set(sid.tolist())) - 1
