"""Operators that look at one document at a time."""

import math
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pageloom.llm import decontaminate, html_text, packing, quality_classifier, quality_rules, registry, toxicity
from pageloom.llm import tokens as T
from tests.llm.cases import corpus, frame, vocabulary, words


def test_words_and_windows():
    texts = [t for _, t in corpus()]
    got, seen = [], {}
    for s in T.slices(pa.array(texts), 5000):
        w = T.words(s)
        for i in range(s.hi - s.lo):
            got.append([s.buf[a:b].tobytes().decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])])
        for h, a, b in zip(T.word_hashes(s, w).tolist(), w.start, w.end):
            assert seen.setdefault(h, s.buf[a:b].tobytes()) == s.buf[a:b].tobytes()
    assert got == [words(t) for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_quality_ledger_equals_sql(spark):
    docs = frame(spark, corpus())
    got = quality_rules.verdicts(quality_rules.ledger(docs)).toPandas()
    con = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841
    want = con.sql(quality_rules.ORACLE_SQL.replace("FROM documents", "FROM (SELECT doc_id::BIGINT AS doc_id, text FROM documents)")).df()
    key = lambda d: sorted(map(repr, d[sorted(want.columns)].astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    as_int = lambda d: d.assign(doc_id=d.doc_id.fillna(-1).astype(int))
    assert key(as_int(got)) == key(as_int(want))


def test_policies_and_ablations(spark):
    book = quality_rules.ledger(frame(spark, [(1, "word " * 60), (2, " ".join(f"word{i}" for i in range(60))), (3, "### *** " * 40), (4, None)]))
    kept = {r.doc_id: r.kept for r in quality_rules.verdicts(book, "v1").collect()}
    assert kept == {1: False, 2: True, 3: False, 4: False}
    rows = {r.rule: r for r in quality_rules.ablations(book, "v1").collect()}
    assert rows["symbols"].n_fail == 1 and rows["too_few_words"].n_only == 1 and rows["too_few_words"].kept_without == 2
    assert quality_rules.ledger(frame(spark, [])).count() == 0
    out = quality_rules.filtered(frame(spark, [(1, "x"), (2, " ".join(f"word{i}" for i in range(60)))]))
    assert [r.doc_id for r in out.collect()] == [2] and "sid" in out.columns


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = corpus()
    got = packing.packed(frame(spark, rows), length=64).collect()
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = {}
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.setdefault(i, []).append(ids)
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, docs in want.items():
        assert sum(r.length for r in pieces[i]) == sum(map(len, docs))
        for r in pieces[i]:
            assert any(len(d) == r.doc_tokens and zlib.crc32(np.array(d[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for d in docs)
    at = sorted((r.sequence_id, r.offset, r.length) for r in got)
    place = 0
    for s, o, n in at:
        assert s * 64 + o == place and o + n <= 64
        place += n
    assert packing.packed(frame(spark, [])).count() == 0


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path(), cache=50)
    texts = ["it's, don't; x.y,z!?**a é,f\n\nG\nH a1,b2 $5%x ×, café. naïve*** A.\n", "a  b\n\n c <|endoftext|> d", " <|endoftext|>x", "x   y  \n\tz ", " ", "", "\r\n a's\x1f b", "é　 k  m", "\x00 \x00a \x0b\x0c q", *(t or "" for _, t in corpus())]
    for _ in range(2):
        assert [np.frombuffer(x, np.uint32).tolist() for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_equals_tokenizer_on_odd_strings(monkeypatch):
    """Tables that overflow, and long texts cut into slices of a few bytes, where a cut inside white space would show."""
    import random

    from tokenizers import Tokenizer

    r, tok = random.Random(4), Tokenizer.from_file(packing.tokenizer_path())
    signs = [*"aabrestTHE 019  \n\n\r\t\x0b''.,!|<>()-_\"\x00\x7f", "é", "×", "÷", "ÿ", "ɏ", "ɀ", "ª", "²", "\u0301", "ж", "中", "—", " the", "'s", "'re", "'ll", "\x1c", "\x85", "\xa0", "\u2009", "\u3000", "<|endoftext|>"]
    texts = ["".join(r.choices(r.sample(signs, r.randint(2, 12)), k=r.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(r.choices(signs[:-6], k=3000)), "a" * 3000, "x " * 1000, "b" + " " * 2000 + "y"]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    for cache, size in ((1 << 20, 1 << 20), (50, 500), (3, 40)):
        monkeypatch.setattr(packing, "SLICE_BYTES", size)
        enc = packing.Encoder(packing.tokenizer_path(), cache=cache)
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == want


def test_encoder_asks_for_a_part_once():
    """Words with signs and digits about them, and words of up to 15 bytes, cost the tokenizer no more than the words."""
    import random

    enc = packing.Encoder(packing.tokenizer_path())
    plain, asked = enc.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return plain.encode_batch_fast(texts, **more)

    enc.tokenizer = Counted()
    v = [*vocabulary(random.Random(2), 40), "responsibility", "incomprehensib"]
    text = " ".join(f"{a}{x}{w}{b}" for w in v for a in ("", "(", "[", '"') for x in ("", "7-", "42/") for b in ("", ")", ".", '."', "_1", "]9"))
    want = plain.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(enc.encode([text])[0], np.uint32).tolist() == want
    assert sum(map(len, asked)) < len(text) / 10
    asked.clear()
    assert np.frombuffer(enc.encode([text])[0], np.uint32).tolist() == want and not asked


def test_stored_ids_are_narrow_where_they_fit():
    ids, first = np.array([1, 70000, 2, 65535], np.uint32), np.array([0, 2, 2, 4])
    for x, n in ((ids, [8, 0, 4]), (ids[[0, 0, 2, 3]], [4, 0, 4])):
        got = packing._binary(x, first).to_pylist()
        assert list(map(len, got)) == n
        for a, b, raw in zip(first, first[1:], got):
            assert np.frombuffer(raw, np.uint16 if len(raw) == 2 * (b - a) else np.uint32).tolist() == x[a:b].tolist()


def test_tiles_and_contamination(spark):
    item = " ".join(f"w{i}" for i in range(40))
    w = item.split()
    rows = [(1, "start of it " + item + " and more"), (2, " ".join(w[20:]) + " in between " + " ".join(w[:20])), (3, "nothing here"), (4, None), (5, " ".join(w[:12])), (None, item.upper().replace(" ", ", "))]
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (10, " ".join(f"v{i}" for i in range(30)))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_tiled, r.n_tiles) for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert got == {(1, 7): (40, 1), (2, 7): (40, 2), (None, 7): (40, 1)}
    small = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, rows), bench, chunk_bytes=100).collect()}
    assert small == set(got)
    assert sorted(r.doc_id for r in decontaminate.filtered(frame(spark, rows), bench).collect()) == [3, 4, 5]
    a, b = (np.array([ord(c) for c in x], np.uint64) for x in ("abcdefgh-ijklmn", "ijklmn+abcdefgh"))
    assert sorted(decontaminate.tiles(a, b)) == [(0, 7, 8), (9, 0, 6)]


def _plain_tiling(item, doc, least):
    """The longest common run of unmarked words, the first in item and document, marked again and again."""
    free_i, free_d, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and free_i[i + k] and free_d[j + k] and item[i + k] == doc[j + k]:
                    k += 1
                if k > best[2]:
                    best = (i, j, k)
        i, j, k = best
        if k < least:
            return out
        out.append(best)
        for d in range(k):
            free_i[i + d] = free_d[j + d] = False


def test_tiles_equal_plain_greedy_tiling():
    import random

    r = random.Random(1)
    for _ in range(1000):
        letters, least = r.choice((2, 3, 5, 9)), r.choice((1, 2, 3, 5))
        item, doc = [r.randrange(letters) for _ in range(r.randint(0, 25))], [r.randrange(letters) for _ in range(r.randint(0, 25))]
        for _ in range(r.randint(0, 4)):
            i, p = r.randrange(len(item) + 1), r.randrange(len(doc) + 1)
            doc[p:p] = item[i : i + r.randint(1, 12)]
        assert decontaminate.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), least) == _plain_tiling(item, doc, least)


def test_contamination_equals_brute_force(spark):
    """Every pair against plain tiling, with seeds that all items share, repeated items, short ones, null ids and a very long text."""
    import random

    r = random.Random(3)
    hot = "which of the following is the best answer".split()
    items = [(i, hot + [f"q{r.randrange(60)}" for _ in range(r.randint(3, 30))]) for i in range(25)]
    items += [(None, items[3][1]), (4, items[4][1]), (90, "two words".split()), (91, "four words in all".split()), (92, []), (93, [f"w{i}" for i in range(19)])]
    docs = [(i, [f"q{r.randrange(60)}" for _ in range(r.randint(0, 40))]) for i in range(30)]
    for i in range(40):
        w = [f"z{r.randrange(30)}" for _ in range(30)]
        for _ in range(3):
            x = r.choice(items)[1]
            a = r.randrange(len(x) + 1)
            p = r.randrange(31)
            w[p:p] = x[a : a + r.randint(3, 25)]
        docs.append((100 + i, w))
    docs += [(200, "w0 w1 w2 w3 w4 w5 w6 zz w5 w6 w7 w8 w9 w10 w11 w12 yy w5 w6 w7 w8 w9 w10 w11 w12 end".split()), (None, items[3][1]), (201, ["x"] * 60_000 + items[5][1]), (201, items[6][1]), (202, [])]
    want = []
    for i, d in docs:
        for j, x in items:
            least = min(decontaminate.MIN_RUN, len(x))
            tail = d[-100:] if len(d) > 1000 else d
            n = sum(k for _, _, k in _plain_tiling(x, tail, least)) if x else 0
            if len(x) < decontaminate.MIN_RUN:
                n = len(x) * any(d[p : p + len(x)] == x for p in range(len(d))) if x else 0
            if x and n >= decontaminate.COVERAGE * len(x):
                want.append((i is None, i or 0, j is None, j or 0, n))
    bench = spark.createDataFrame([(i, " ".join(x) or None) for i, x in items], "item_id long, text string")
    rows = [(i, " ".join(d)) for i, d in docs] + [(300, None), (301, "")]
    got = decontaminate.contaminated(frame(spark, rows), bench).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.item_id is None, r.item_id or 0, r.n_tiled) for r in got) == sorted(want)
    assert any(w[1] == 200 and w[4] == 13 for w in want)
    bad = Counter((w[0], w[1]) for w in want)
    kept = Counter((r.doc_id is None, r.doc_id or 0) for r in decontaminate.filtered(frame(spark, rows), bench).select("doc_id").collect())
    assert set(kept) == {(i is None, i or 0) for i, _ in rows} - set(bad) | ({(False, 201)} & set(kept))
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0 and decontaminate.contaminated(frame(spark, rows), empty).count() == 0
    assert decontaminate.filtered(frame(spark, rows), empty).count() == len(rows)


def test_html(spark):
    model = html_text.Model(html_text.labelled_pages())
    page = lambda body: f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"
    text = "Some long sentence with many words that tell a story to the reader."
    cases = {
        page(f"<nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>The &eacute;nd &amp; more</h1><p>{text}<br>next  line</p><script>x='<p>no</p>'</script></article><footer>&copy; me</footer>"): f"The énd & more\n{text} next line",
        page(f"<header><h1>Site</h1></header><div id=content><p>{text}<p>{text}</div><aside><p>{text}</p></aside><div class='comments'><p>{text}</p></div><form><label>Mail</label><button>Go</button></form>"): f"{text}\n{text}",
        page(f"<div class='cookie-notice'><p>{text}</p></div><main><p>{text}</p><div class='ad'><p>{text}</p></div></main>"): text,
        "plain text": "plain text", "": "", None: "", "<article><p>A &amp b &am": "A & b &am",
    }
    assert model.texts(list(cases)) == list(cases.values())
    pages = spark.createDataFrame([(i, "u", h, 1) for i, h in enumerate(cases)] + [(None, None, None, 2)], "page_id long, url string, html string, text int")
    got = html_text.extracted(pages).collect()
    assert sorted((r.page_id is None, r.page_id, r.n_chars) for r in got if r.page_id is not None) == [(False, i, len(t)) for i, t in enumerate(cases.values())]
    held = html_text.labelled_pages(150, seed=3)
    right = total = 0
    for p in held:
        t = html_text.Trees()
        t.parse(0, p)
        a = t.arrays()
        leaf = a["kind"] == html_text._LEAF
        right += int(((model.marginals(a)[:, 1] >= 0.5) == (a["label"] == 1))[leaf].sum())
        total += int(leaf.sum())
    assert right / total > 0.97


def test_messages_equal_enumeration():
    """Marginals of a small tree against the sum over all labellings."""
    import itertools

    model = html_text.Model(html_text.labelled_pages(60))
    t = html_text.Trees()
    t.parse(0, "<div class=menu><p>a b</p></div><div><p>Some words in a longer line here.</p></div>")
    a = t.arrays()
    n = len(a["parent"])
    leaf = a["kind"] == html_text._LEAF
    total = np.zeros((n, 3))
    for y in itertools.product(range(3), repeat=n):
        s = 0.0
        for i in range(n):
            own = model.size[a["size"][i]] + model.links[a["links"][i]] + model.ends[a["ends"][i]] if leaf[i] else model.hint[a["hint"][i]]
            s += (-1e3 if y[i] == 0 and leaf[i] else 0) + (own[y[i]] if a["parent"][i] >= 0 else (0, -20, -20)[y[i]])
            if a["parent"][i] >= 0:
                s += model.pair[a["kind"][i]][y[a["parent"][i]], y[i]]
        for i in range(n):
            total[i, y[i]] += math.exp(s)
    assert np.allclose(total / total.sum(1, keepdims=True), model.marginals(a), atol=1e-6)


def test_quality_classifier(spark):
    good = [(i, " ".join(f"nice{(i * 7 + k) % 50}" for k in range(30)), 1) for i in range(60)]
    bad = [(100 + i, " ".join(f"###{(i * 5 + k) % 40}$$" for k in range(30)), 0) for i in range(60)]
    sample = spark.createDataFrame([(i, t, y) for i, t, y in good + bad], "doc_id long, text string, label int")
    docs = frame(spark, [(1000, good[3][1]), (1001, bad[3][1]), (1002, None), (1003, ""), (None, "nice1"), (1004, "nice2 " * 30_000)])
    got = {r.doc_id: r for r in quality_classifier.scored(docs, sample).collect()}
    assert got[1000].predicted == 1 and got[1001].predicted == 0 and got[1002].score == got[1003].score and got[None].held_out is None
    assert quality_classifier.scored(docs, sample.limit(0)).first().score == pytest.approx(0.5)
    assert quality_classifier.scored(frame(spark, []), sample).count() == 0


def test_levenshtein_automaton():
    def distance(a, b):
        """At most one insertion, deletion, substitution or swap of neighbours."""
        if a == b:
            return 0
        letters = {*a, *b}
        near = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in letters} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in letters}
        near |= {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        return 1 if b in near else 2

    terms = ["idiot", "scum", "clown", "moron", "morons"]
    auto = toxicity.Automaton([(t.encode(), 1.0 + i) for i, t in enumerate(terms)])
    seen = ["idiot", "idoit", "idot", "idiiot", "1diot", "idiots", "scum", "scums", "cl0wn", "lcown", "clwn", "moron", "morns", "mrons", "other", "i", "", "clown1x"]
    buf = np.frombuffer("".join(seen).encode(), np.uint8)
    ends = np.cumsum([len(x) for x in seen])
    idx, term, edits = auto.find(buf, ends - [len(x) for x in seen], ends)
    got = {seen[i]: int(e) for i, e in zip(idx, edits)}
    want = {}
    for x in seen:
        best = min((distance(t, x) for t in terms if len(t) >= 5 or t == x), default=2)
        if best < 2:
            want[x] = best
    assert got == want


def test_toxicity(spark):
    docs = frame(spark, [(1, "what a nice day it is " * 5), (2, "you are an idiot and a moron, you scum"), (3, 'he said "idiot" is a bad word to use in a text like this one here'), (4, "you absolute idoit and mor0n"), (5, None), (6, ""), (None, "you idiot")])
    got = {r.doc_id: r for r in toxicity.scored(docs, spark.createDataFrame([], "doc_id long, text string, label int")).collect()}
    assert got[2].predicted == 1 and got[4].predicted == 1 and got[1].predicted == got[3].predicted == got[5].predicted == 0
    assert got[3].quoted > 0 and got[2].directed > 0 and got[4].fuzzy > 0 and got[None].held_out is None
    assert toxicity.scored(frame(spark, []), spark.createDataFrame([], "doc_id long, text string, label int")).count() == 0


def test_broken_pages(spark):
    """Optional tags, elements that nothing closes, and very deep pages; the text of the Spark path is compared."""
    text = "Some long sentence with many words that tell a story to the reader."
    cases = {
        f"<html><head><title>T</title><p>{text}<p>{text}": f"{text}\n{text}",
        f"<html><head><title>T</title><div><article><p>{text}</p></article></div>": text,
        f"<article><p>{text}</p><video src=x><p>{text}</p></article>": f"{text}\n{text}",
        f"<article><p>{text}</p><!-- x --!><p>{text}</p></article>": f"{text}\n{text}",
        "<article><p>A super<wbr>market and an<img src=x>other b<!-- c -->ig <svg/>thing to read about.</p></article>": "A supermarket and another big thing to read about.",
        f"<article><p>{text}</p><video><p>no</p></video><svg><text>no</text></svg><noscript>no</noscript></article>": text,
        f"<article><p>{text}</p><script>never closed <p>{text}": text,
        "<div>" * 20_000 + text + "</span></div></p>" * 20_000: text,
        "<article><p>" + f"{text} " * 20_000 + "</p></article>": (f"{text} " * 20_000).strip(),
        "   \n": "", "": "",
    }
    rows = [(i, "u", h) for i, h in enumerate(cases)] + [(None, None, None), (0, "v", next(iter(cases)))]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = [(i, "u", t, len(t)) for i, t in enumerate(cases.values())] + [(None, None, "", 0), (0, "v", f"{text}\n{text}", 2 * len(text) + 1)]
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality_scores_equal_brute_force(spark):
    """Scores from the learned values by plain loops over words, pairs and byte runs; ties, repeated rows and very long texts score alike."""
    import random

    r = random.Random(2)
    good, bad = vocabulary(r, 80), [x[::-1] + "q" for x in vocabulary(r, 80)]
    rows = [(i, " ".join(r.choices(good if i % 2 else bad, k=r.randint(5, 40)))) for i in range(60)]
    rows += [(70, rows[1][1]), (70, rows[1][1]), (71, None), (72, ""), (73, "one"), (74, "same same same"), (75, " ".join(good) * 200), (None, "é ü ñ"), (76, "ab")]
    sample = spark.createDataFrame([(i, t, i % 2) for i, t in rows[:50]], "doc_id long, text string, label int")
    value, bias = quality_classifier.train([t for _, t in rows[:50]], [i % 2 for i in range(50)])
    shift, mask = 64 - quality_classifier.BITS, (1 << 64) - 1

    def score(text):
        (s,) = T.slices(pa.array([text or ""]), 1 << 40)
        h = [int(x) for x in T.word_hashes(s, T.words(s))]
        pairs = [0x5851F42D4C957F2D if a == b else int(T.window_hashes(np.array([a, b], np.uint64), 2)[0]) for a, b in zip(h, h[1:])]
        groups, raw = [[x >> shift for x in h + pairs]], (text or "").encode()
        for k in (3, 4):
            codes = []
            for i in range(len(raw) - k + 1):
                code = k
                for c in raw[i : i + k]:
                    code = (code << 8 | c) & mask
                codes.append((code * T._BASE & mask) >> shift)
            groups.append(codes)
        return 1 / (1 + math.exp(-(bias + sum(sum(float(value[x]) for x in g) / len(g) for g in groups if g))))

    got = Counter((x.doc_id, round(x.score, 6), x.predicted) for x in quality_classifier.scored(frame(spark, rows), sample).collect())
    assert got == Counter((i, round(score(t), 6), int(score(t) >= 0.5)) for i, t in rows)


def _edits(a, b):
    """Edits between two byte strings; a swap of neighbours is one."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_toxicity_scores_equal_brute_force(spark):
    """Sums of hits by comparing every word with every term; repeated rows, ties and very long texts among them."""
    import random
    import re

    r = random.Random(6)
    terms = toxicity.TERMS
    vary = lambda t: r.choice((t, t[1:], t[:2] + "x" + t[2:], t[:1] + t[2:3] + t[1:2] + t[3:], t + "zz"))
    rows = [(i, " ".join(vary(r.choice(terms)) if r.random() < 0.2 else r.choice(("plain", "you", "said", "words", "tree")) for _ in range(r.randint(0, 30)))) for i in range(40)]
    rows += [(50, rows[3][1]), (50, rows[3][1]), (51, None), (52, "word " * 30_000 + "idiot"), (53, "he said idiot and moron you"), (None, "scum")]
    want, known = Counter(), [t.encode() for t in terms]

    def hits(words_):
        out = dict.fromkeys(("exact", "fuzzy", "quoted", "directed"), 0.0)
        memo = {}
        for i, x in enumerate(words_):
            if x not in memo:
                b = x.encode()
                memo[x] = 0 if b in known else 1 if any(abs(len(b) - len(t)) < 2 and len(t) >= 5 and _edits(b, t) <= 1 for t in known) else 9
            if memo[x] > 1:
                continue
            before, after = words_[max(0, i - 12) : i], words_[i + 1 : i + 5]
            quoted = any(y.encode() in toxicity.REPORTING for y in before[-4:])
            out["quoted" if quoted else "fuzzy" if memo[x] else "exact"] += toxicity.FIXED_WEIGHT
            out["directed"] += toxicity.FIXED_WEIGHT * (not quoted and any(y.encode() in toxicity.SECOND for y in before[-4:] + after))
        return out

    for i, t in rows:
        w = re.findall(r"\S+", t or "")
        h, p = hits(w), toxicity.PRIOR
        plain = h["exact"] + h["fuzzy"] / 2
        z = p @ [1, math.log1p(h["exact"]), math.log1p(h["fuzzy"]), math.log1p(h["quoted"]), plain / (plain + len(w) / 20 + 1), math.log1p(h["directed"])]
        want[i, round(1 / (1 + math.exp(-z)), 9)] += 1
    got = toxicity.scored(frame(spark, rows), spark.createDataFrame([], "doc_id long, text string, label int")).collect()
    assert Counter((x.doc_id, round(x.score, 9)) for x in got) == want and len({x.predicted for x in got}) == 2


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/labels.parquet"), reason="needs the test tables")
@pytest.mark.parametrize(("query", "label", "recall"), [("op8_quality_classifier", "quality", 0.97), ("op10_toxicity", "toxic", 0.9)])
def test_held_out_figures(spark, query, label, recall):
    """On documents whose labels were never learned from: area under the curve, recall and false alarms."""
    d = "/root/testdata/sf0.1"
    labels = {x.doc_id: x[label] for x in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [(x.score, labels[x.doc_id]) for x in registry.QUERIES[query](spark, d).where("held_out").collect() if x.doc_id in labels]
    ones, zeros = np.array([s for s, y in got if y]), np.array([s for s, y in got if not y])
    auc = np.mean((ones[:, None] > zeros) + 0.5 * (ones[:, None] == zeros))
    assert len(ones) > 50 and auc >= 0.95 and (ones >= 0.5).mean() >= recall and (zeros >= 0.5).mean() <= 0.03
