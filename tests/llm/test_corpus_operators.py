"""The corpus operators against plain versions, on small and hostile inputs."""

import hashlib
import itertools
import random
import tracemalloc
import zlib

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailsift.llm import bpe, chat, common, decontaminate, html, linededup, lm, neardup, quality, registry, suffix, warc

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "word", "a b c d", "ab " * 300, "é ü ß\x0b\x1c z", "x" * 5000, "\n\n\n", "Same line here.\nSame line here.\nSame line here.\nother"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def odd_docs(spark, clash="_h long, _d string, rare string, kept boolean"):
    data = [(i, t, ("en", None, "xx")[i % 3], 1, "y", "z", True) for i, t in enumerate(ODD)]
    data += [data[3], data[6], (None, "no id at all", "en", 1, "y", "z", None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, {clash}")


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_words_and_shingles():
    texts = ["a bb  c", None, "", "d\te\nf g h i", "é\x1cü x"]
    data, offsets = common.flat(pa.array(texts))
    start, end, bounds = common.words(data, offsets)
    got = [[bytes(data[a:b]).decode() for a, b in zip(start[i:j], end[i:j], strict=True)] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [["a", "bb", "c"], [], [], ["d", "e", "f", "g", "h", "i"], ["é\x1cü", "x"]]


def test_quality_counts():
    texts = [*ODD, "a b c d e a b c d e f", "# $ %\nx\nx", *["w%d" % (i % 7) for i in range(20)]]
    data, offsets = common.flat(pa.array(texts))
    found = quality.surface(data, offsets)
    for i, t in enumerate(texts):
        assert tuple(int(found[k][i]) for k in quality.STATS) == brute.base_counts(t), t


def test_kneser_ney_is_a_distribution():
    data, offsets = common.flat(pa.array(["the cat sat on the Mat and the rat ran", "a dog, a log; a fog"] * 3))
    code, _ = quality.codes(data, offsets)
    n = np.bincount(code, minlength=quality.CODES)
    at = np.flatnonzero(n)
    model = quality.KneserNey(np.zeros(len(at), int), at, n[at])
    for context in [0, int(code[7]) // quality.SYMBOLS, 12345]:
        grams = np.int64(context) * quality.SYMBOLS + np.arange(quality.SYMBOLS)
        assert abs((10 ** model.log10(0, grams)).sum() - 1) < 1e-4


def test_quality_query(spark, docs, rows):
    got = {r.doc_id: r for r in registry.QUERIES["op1_quality"](spark, SF).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        want = brute.base_counts(t)
        assert tuple(got[d][k] for k in quality.STATS) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert got[d].base_failed == failed and not (failed and got[d].kept)
    assert quality.judge(odd_docs(spark)).count() == len(ODD) + 4
    assert quality.judge(empty_docs(spark)).count() == 0


PAGE = """<html><body><div id="menu"><a>Home</a></div><div class="cookie-notice">We use cookies on this site.</div><div class="content"><h1>Title</h1><p>Long text of the article
with <b>bold</b>er words &amp; more.<p>Second para.<div class="comments"><p>nice</p></div></div><aside>Buy now</aside><form><p>mail</p></form><footer>c</footer></body></html>"""


def test_html():
    want = {
        PAGE: "Title Long text of the article with bolder words & more. Second para.",
        "": "",
        "plain &lt;text&gt; only": "plain <text> only",
        "<article><h1>T</h1><p>x&nbsp; y<br>z</p><script>var a='</p>'</script><ul><li>a<li>b</ul></article><footer>f</footer>": "T x y z a b",
        "<nav><a href=1>x</a><article><p>text</article>": "text",
        "<article><p>Be.</p><div class=ad>Buy</div><p>Go &#233;.</p>": "Be. Go é.",
        "<body class='has-sidebar'><main><p>M</p></main><div class='sidebar'><p>a long text in the side bar, much longer than main</p></div>": "M",
    }
    for page, text in want.items():
        assert html.main_text(page) == text
        assert html.main_text(page, chunk=3) == text


PLAIN = """<body><div><a href=1>Home</a><a href=2>News</a></div><div><ul><li><a href=3>One</a></li><li><a href=4>Two</a></li><li><a href=5>Three</a></li><li><a href=6>Four</a></li></ul></div><div><h1>A title</h1>
<p>%s</p><p>%s</p></div><div><ul>%s</ul></div></body>""" % ("Long prose of the page. " * 20, "More prose that follows it. " * 20, "<li><a href=7>A longer link</a></li>" * 150)


def test_html_clusters_decide_where_names_say_nothing(monkeypatch):
    """No element or class tells menu from text here: ratios do."""
    want = " ".join(("A title " + "Long prose of the page. " * 20 + "More prose that follows it. " * 20).split())
    assert html.main_text(PLAIN) == want
    monkeypatch.setattr(html, "clusters", lambda size, tags: (size >= 0, size >= 0))
    assert html.main_text(PLAIN) != want


def test_html_weak_names_only_break_ties():
    text = "A paragraph of the article that is long enough to be content by itself. " * 6
    page = f"<article><p>{text}</p><div class=related><p>{text}</p></div><div class=share><a href=1>x</a><a href=2>y</a></div><p>{text}</p></article>"
    assert html.main_text(page) == " ".join([text.strip()] * 3)


@pytest.mark.parametrize("page", ["<div>x ", "<b>x<p>", "<article><p>some text</p></article>", "<blockquote><i>x<li>", "</i><div><span>"])
def test_html_is_linear_in_depth(page):
    import time

    took = []
    for n in (1000, 8000):
        begun = time.process_time()
        html.main_text(page * n)
        took.append(time.process_time() - begun)
    assert took[1] < 30 * max(took[0], 0.01)


def test_html_against_a_plain_extractor():
    """Generated pages whose article is known; the region has no article element."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
    for _ in range(40):
        paragraphs = [" ".join(word() for _ in range(r.randrange(40, 90))) for _ in range(r.randrange(3, 7))]
        links = lambda n: "<ul>" + "".join(f"<li><a href=/{word()}>{word()}</a></li>" for _ in range(n)) + "</ul>"
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        page = f"<html><body><div>{links(r.randrange(5, 15))}</div><nav>{links(4)}</nav><div><section>{body}</section></div><div class=comments><p>{word()} {word()}</p></div><div>{links(r.randrange(5, 25))}</div><footer>{word()}</footer></body></html>"
        assert html.main_text(page) == " ".join(paragraphs)


def test_html_rows(spark):
    df = spark.createDataFrame([(1, None, None), (1, "u", "<p>a"), (None, "u", "<p>b")], "page_id long, url string, html string")
    assert sorted((r.text, r.n_chars) for r in html.extract(df).collect()) == [("", 0), ("a", 1), ("b", 1)]
    assert html.extract(df.limit(0)).count() == 0


def test_line_dedup(spark, rows):
    r = random.Random(5)
    pool = [f"line number {i} of the pool" for i in range(12)] + [" ".join(f"w{i}" for i in range(55))]
    made = [(i, "\n".join(r.choice(pool) if r.random() < 0.8 else r.choice(["", "own %d" % r.randrange(9**9)]) for _ in range(r.randrange(14)))) for i in range(60)]
    for data in (made, rows):
        data = sorted(data)
        df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
        for long in (False, True):
            got = {x.row.doc_id: x.text for x in linededup.dedup_lines(df, long=long).collect()}
            assert [got[d] for d, _ in data] == brute.dedup_lines([t for _, t in data], long=long)


@pytest.mark.parametrize("n", [512, 1024, 2048])
def test_texts_that_hash_alike_modulo_powers_of_two(spark, n):
    a, b = brute.thue_morse(n)
    tail = " ".join(f"w{i}" for i in range(30))
    texts = [f"{a}\n{b}\n{a}", f"{a} x y z u\n{b} x y z u", f"x\n{a}\ny", f"x\n{b}\ny", f"{a} {tail}", f"{b} {tail}", f"{a}{a}", f"{b}{b}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    data, offsets = common.flat(pa.array(texts))
    found = quality.surface(data, offsets)
    for i, t in enumerate(texts):
        assert tuple(int(found[k][i]) for k in quality.STATS) == brute.base_counts(t)
    got = {x.row.doc_id: x.text for x in linededup.dedup_lines(df, long=True).collect()}
    assert [got[i] for i in range(len(texts))] == brute.dedup_lines(texts, long=True)
    assert {x.row.doc_id: x.class_id for x in neardup.mark_near(df).collect()} == brute.near_classes(enumerate(texts))
    kept = suffix.drop_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert [tuple(x)[1:] for x in sorted(kept)] == brute.long_repeats(texts, 400)


def test_span_comparison():
    data = np.frombuffer(b"abcabcabdab", np.uint8)
    a, b, n = np.array([0, 0, 3, 0, 4]), np.array([3, 3, 6, 9, 0]), np.array([3, 4, 3, 2, 0])
    want = [bytes(data[x : x + k]) == bytes(data[y : y + k]) for x, y, k in zip(a, b, n, strict=True)]
    assert common.same_bytes(data, a, b, n).tolist() == want and common.same_bytes(data, a, b, n, most=2).tolist() == want
    roll = common.Rolling(data)
    assert roll.same(a, b, n).tolist() == want
    h = roll.windows(3)
    assert (h[0] == h[3]) and h[0] != h[6]


def test_quality_bands_reject_what_is_no_prose(spark):
    r = random.Random(11)

    def prose(parts, n=300):
        out = []
        while len(out) < n:
            sentence = ["".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(4, 12))]
            out += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1] + "."]
        return " ".join(out[:n])

    en, de = "the and ing tion er of th re at in on ou".split(), "sch ein der ung keit ich zu ver tz pf ö ü".split()
    clean = [("en", prose(en)) for _ in range(150)] + [("de", prose(de)) for _ in range(150)]
    mixed = [("de", "\n".join([prose(de, 150), prose(en, 100), prose(de, 150)])) for _ in range(10)]

    def shuffled(t):
        w = t.split()
        r.shuffle(w)
        return " ".join(w)

    bad = [("en", prose(de)) for _ in range(10)] + [("en", shuffled(prose(en))) for _ in range(10)] + [("en", prose(en).upper()) for _ in range(10)]
    bad += [("en", " ".join("".join(c + r.choice(["", "", "#", "%", "&"]) for c in w) for w in prose(en).split())) for _ in range(10)] + [("de", " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(200))) for _ in range(10)]
    rows = [(i, t, lang) for i, (lang, t) in enumerate([*clean, *mixed, *bad])]
    found = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    got = {x.row.doc_id: x.kept for x in found}
    n, m = len(clean), len(clean) + len(mixed)
    assert sum(got[i] for i in range(n)) >= 0.97 * n
    assert sum(got[i] for i in range(n, m)) >= 9
    assert sum(got[i] for i in range(m, len(rows))) <= 0.1 * len(bad), [sum(got[i] for i in range(k, k + 10)) for k in range(m, len(rows), 10)]


ODD_NAMES = "_h long, _d string, row string, kept boolean, `a b` struct<`c d`: int, row: string>, n_removed long, class_id string, is_first int, n_words int"


def test_names_of_the_caller_do_not_clash(spark):
    data = [(i, t, "en", 1, "y", "z", True, (3, "q"), 7, "c", 9, 5) for i, t in enumerate([*ODD, *ODD])]
    df = spark.createDataFrame(data, f"doc_id long, text string, lang string, {ODD_NAMES}")
    for out in (quality.judge(df), linededup.dedup_lines(df, long=True), neardup.mark_near(df), decontaminate.decontaminate(df, spark.createDataFrame([(1, "a b c")], "item_id long, text string"))):
        assert sorted(map(str, out.select("row.*").collect())) == sorted(map(str, df.collect()))
    assert set(neardup.first_of_each(df).columns) == set(df.columns)


def test_ids_that_have_no_order_are_refused(spark):
    df = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    for f in (linededup.dedup_lines, neardup.mark_near, suffix.drop_repeats):
        with pytest.raises(TypeError):
            f(df)


def test_line_dedup_long_lines_and_pairs(spark):
    words, chars = " ".join(f"w{i}" for i in range(50)), "é" * 200
    pairs = [f"pair {i}\nmate {i}" for i in range(20)]  # winnowing in windows of two leaves some of these to chance
    texts = [words, f"own a\n{words}\nown b", f"x\n{chars}", chars, words[:-4], f"{words[:-4]}\nshort", "short"]
    texts += [f"a{i}\n{p}\nb{i}" for i, p in enumerate(pairs)] + [f"c{i}\n{p}\nd{i}" for i, p in enumerate(pairs)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [x.text for x in sorted(linededup.dedup_lines(df, long=True).collect(), key=lambda x: x.row.doc_id)]
    assert got[:7] == [words, "own a\nown b", f"x\n{chars}", "", *texts[4:7]]
    assert got[7:27] == texts[7:27] and got[27:] == [f"c{i}\nd{i}" for i in range(20)]


def test_line_dedup_odd(spark):
    out = linededup.dedup_lines(odd_docs(spark))
    assert out.count() == len(ODD) + 4
    assert {r.text for r in out.collect()} <= set(ODD) | {"no id at all", "Same line here.\nother"}
    assert linededup.dedup_lines(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("group,walk", [(2000, 32), (3, 32), (2000, 1)])
def test_suffix_small(spark, group, walk):
    r = random.Random(group + walk)
    base = "".join(r.choice("abcé ") for _ in range(300))
    texts = [None, "", "ab" * 90, base, base]
    for _ in range(30):
        a, t = r.randrange(200), list(base[: r.randrange(300)])
        for _ in range(3):
            if t:
                t[r.randrange(len(t))] = "q"
        texts += ["".join(t), "".join(r.choice("xyz") for _ in range(r.randrange(60))) + base[a : a + r.randrange(100)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = suffix.drop_repeats(df, length=40, gram=12, group=group, walk=walk).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert [tuple(x)[1:] for x in sorted(got)] == brute.long_repeats(texts, 40)


def test_suffix_anchors_past_16_mib():
    r = np.random.default_rng(8)
    before, tail = r.integers(97, 123, (1 << 24) - 900, np.uint8), r.integers(97, 123, 5000, np.uint8)
    whole = suffix.segments(np.concatenate([before, tail]), np.array([0, len(before) + len(tail)]), 400, 128)
    alone = suffix.segments(tail, np.array([0, len(tail)]), 400, 128)
    assert (whole["off"] >= 0).all() and (whole["off"] <= 400 - 128).all() and whole["n"].sum() == len(before) + len(tail) - 399
    # All but the first segment, which begins before the tail, are those of the tail by itself.
    found = {tuple(x) for x in zip(whole["lo"] - len(before), whole["n"], whole["off"], whole["key"], whole["s1"], whole["s2"], strict=True)}
    assert {x for x in zip(*(alone[k] for k in ("lo", "n", "off", "key", "s1", "s2")), strict=True) if x[0]} <= found


def test_suffix_query(spark, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.QUERIES["op4_suffix"](spark, SF).collect()}
    assert [got[d] for d, _ in rows] == brute.long_repeats([t for _, t in rows], 400)
    assert suffix.drop_repeats(odd_docs(spark)).count() == len(ODD) + 4
    assert suffix.drop_repeats(empty_docs(spark)).count() == 0


def test_bpe_equals_library(spark, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_file())
    with open(bpe.default_file(), encoding="utf-8") as f:
        mine = bpe.Tokenizer(f.read())
    r = random.Random(2)
    texts = [t for _, t in rows[:60]] + [t or "" for t in ODD] + ["a<|endoftext|>b <|startoftext|>", "ΑΣ ΣΑΣ İ ǅ ﬁ Å é", "it's we'll 're''s", "\x1c\x1d a\x85b\xa0c​d", "日本語 🙂👩‍👧", "!" * 700]
    texts += ["".join(r.choice("etaoinshrdlu") for _ in range(n)) for n in (1, 7, 40, 400, 3000)]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x500), r.randrange(0x4E00, 0x5000), r.randrange(0, 32)])) for _ in range(50)) for _ in range(60)]
    decoder = bpe.Decoder(mine)
    for t in texts:
        e = lib.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == e
        assert mine.decode(e, joined=True) == lib.decode(e, skip_special_tokens=False)
        d = hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest()
        assert mine.digests(t) == (len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), d)
    assert "".join(decoder.feed(i) for i in mine.encode("grüße 🙂 naïve")) + decoder.close() == "grüße 🙂 naïve "
    assert bpe.encode(odd_docs(spark), with_ids=True).filter("n_tokens = size(ids)").count() == len(ODD) + 4


def test_bpe_holds_little():
    """Tokens come out long before a word's end."""
    with open(bpe.default_file(), encoding="utf-8") as f:
        machine = bpe.Tokenizer(f.read()).machine
    given = 0

    def endless():
        nonlocal given
        while True:
            given += 1
            yield 97 + given * 7 % 26

    stream = machine.tokens(endless())
    for _ in range(500):
        next(stream)
    assert given < 500 * machine.lookahead


def test_language_model(spark, rows):
    want = brute.unigram(rows)
    got = registry.QUERIES["op6_lm"](spark, SF).collect()
    assert len(got) == len(rows)
    gain = 0.0
    for r in got:
        out, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        gain += (r.score - r.base_score) if out else 0
    assert gain > 0  # better than the base on texts it has not seen


def test_network_is_a_distribution():
    words = [b"w%d" % i for i in range(400)]
    counts = list(range(500, 100, -1))
    units = lm.Units(words, counts, 10, sum(counts) + 10, 401, [(b"w0", 0, 0), (b"99", 50, 3)], (700, 140))
    net = lm.Network(units)
    states = np.random.default_rng(0).standard_normal((1, net.hidden)).astype(np.float32)
    n = len(units.cls)
    logp, _ = net.outputs(np.repeat(states, n, axis=0), np.arange(n))
    assert abs(np.exp(logp).sum() - 1) < 1e-4
    seq = [np.array([1, 2, 3] * 40, np.int32), np.array([5], np.int32), np.zeros(0, np.int32)]
    whole, parts = net.score(seq, units.end, lanes=1, window=7), net.score(seq, units.end, lanes=3, window=200)
    assert np.allclose(whole, parts, rtol=1e-4)  # state is carried across windows


def training(df, units):
    return lm.encoded(df, units).filter(~lm.held_out()).select("r", "units")


def test_lanes_hold_tokens_only():
    """One text of two million words among short ones takes memory for its words, not for that many in every lane."""
    texts = [np.ones(2_000_000, np.int16), *[np.ones(5, np.int16)] * 1000]
    tracemalloc.start()
    plan = lm.Lanes(texts, 0, lm.LANES)
    seen = sum(int((unit >= 0).sum()) for unit, _, _, _ in itertools.islice(plan.windows(64), 50))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20 and seen == 50 * 64 + 6000 - (plan.length[1:] > 3200).sum()


def test_lanes_give_every_text_once():
    r = np.random.default_rng(4)
    texts = [r.integers(1, 9, n).astype(np.int16) for n in (0, 3, 50, 1, 7, 7, 20, 0, 11)]
    for lanes, size in ((1, 4), (3, 7), (16, 64)):
        got, before = [[] for _ in texts], [[] for _ in texts]
        for unit, old, fresh, doc in lm.Lanes(texts, 0, lanes).windows(size):
            for i, k in np.argwhere(unit >= 0):
                got[doc[i, k]].append(unit[i, k])
                before[doc[i, k]].append(old[i, k])
                assert fresh[i, k] == (len(got[doc[i, k]]) == 1)
        assert got == [[*t, 0] for t in texts] and before == [[0, *t] for t in texts]


def test_language_model_scores_by_plain_steps(spark):
    """score, word by word from the network's weights and the counts, against the query's."""
    r = random.Random(5)
    data = [(i, " ".join(f"{r.choice('abc')}{r.randrange(300)}" for _ in range(r.randrange(60)))) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    counts = {bytes(x.word): x.c for x in lm.count_words(df).collect()}
    units = lm.learn_units(df, lm.count_words(df))
    net = lm.fit(training(df, units), units)
    p, H = {k: v.astype(float) for k, v in net.p.items()}, net.hidden
    unit = {w: units.encode([w])[1][0] for _, t in data for w in lm.tokens(t)}
    mass = {}  # of each shared unit, over all words that are or could be in it
    for w in counts:
        k = units.encode([w])[1][0]
        mass.setdefault(k, [0, 0])[0] += counts[w]
        mass[k][1] += 1
    sig = lambda x: 1 / (1 + np.exp(-x))
    soft = lambda x: x - np.log(np.exp(x).sum())
    got = {x.doc_id: x.score for x in lm.score_documents(df).collect()}
    for d, text in data[:40]:
        h, last, total = np.zeros(H), units.end, 0.0
        for w in [*lm.tokens(text), None]:
            x, g = p["wx"][last], h @ p["wh"]
            z, s = sig(x[:H] + g[:H] + p["bh"][:H]), sig(x[H : 2 * H] + g[H : 2 * H] + p["bh"][H : 2 * H])
            n = np.tanh(x[2 * H :] + s * (g[2 * H :] + p["bh"][2 * H :]))
            h = (1 - z) * n + z * h
            last = units.end if w is None else unit[w]
            c = units.cls[last]
            total += soft(h @ p["wc"] + p["bc"])[c] / np.log(10)
            total += soft(h @ p[f"wu{c}"] + p[f"bu{c}"])[units.place[last]] / np.log(10)
            if units.shared[last]:
                t, v = mass.get(last, (0, 0))
                total += np.log10(counts.get(w, 0) + 0.5) - np.log10(t + 0.5 * (v + 1))
        assert abs(got[d] - total) < 1e-3 * max(1, abs(total))


def test_language_model_learns_whole_documents(spark):
    r = random.Random(3)
    data = [(i, " ".join(f"w{r.randrange(50)}" for _ in range(40 + i))) for i in range(1, 900) if zlib.crc32(str(i).encode()) % 5 != 1]
    long = [f"w{r.randrange(50)}" for _ in range(2500)]
    nets = []
    for tail in (long[1000:], sorted(long[1000:])):  # the same counts, so the same units
        df = spark.createDataFrame([*data, (1000, " ".join(long[:1000] + tail))], "doc_id long, text string").repartition(3)
        units = lm.learn_units(df, lm.count_words(df))
        nets.append(lm.fit(training(df, units), units))
    assert not np.allclose(nets[0].flat, nets[1].flat, atol=1e-5)
    assert np.allclose(lm.fit(training(df.repartition(5), units), units).flat, nets[1].flat, atol=1e-5)  # however the table is cut
    seen = lm.train_round(training(df, units), units, nets[0].state(), 3, 0.01).agg(F.min("tokens"), F.max("tokens")).first()
    assert tuple(seen) == (units.total, units.total)  # every word and end of every training document


def test_language_model_odd(spark):
    assert lm.score_documents(odd_docs(spark)).count() == len(ODD) + 4
    none = empty_docs(spark)
    assert lm.score_documents(none).count() == 0


def test_warc(spark, tmp_path):
    big = "é" * 50000 + "\r\n\r\nWARC/1.1\r\n" + "WARC/1.1\r\nWARC/1.1\r\n" * 20
    data = [(1, "u", big), (2, "u\r\nx", "a"), (3, None, "a"), (4, "u", None), (5, "u", ""), (None, "u", "a"), (7, "u", big), (7, "u", big), (8, "v", "\r\n\r\n")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/a"
    warc.write_archive(df, path, segment_bytes=1000)
    got = warc.read_archive(spark, path, with_payload=True).collect()
    assert len(got) == len(data)
    bodies = {(r.page_id, r.record_type): bytes(r.payload or b"").decode() for r in got}
    assert bodies[7, "response"] == big and bodies[3, "response"] == "a" and bodies[8, "response"] == "\r\n\r\n"
    refs = sorted(((r.page_id is not None, r.page_id or 0), r.refers_to) for r in got if r.record_type == "revisit")
    assert refs == [((False, 0), 3), ((True, 1), 7), ((True, 2), 3), ((True, 4), 5)]
    assert all(r.payload_bytes == len((dict((a, c) for a, _, c in data)[r.page_id] or "").encode()) for r in got)
    warc.write_archive(df.limit(0), path + "0")
    assert warc.read_archive(spark, path + "0").count() == 0


def test_warc_detects_damage():
    body = warc.chunked(b"hello")
    assert warc.unchunked(body) == b"hello"
    with pytest.raises(ValueError):
        warc.unchunked(body.replace(b"hello", b"hell"))


def test_decontamination_odd(spark):
    bench = spark.createDataFrame([(1, "one two"), (2, "a b c d e f g h i j k"), (3, None), (4, "!!"), (None, "é É z"), (1, "one two")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x ONE-two y"), (2, "a b c d e f g h i j"), (3, "b c d e f g h i j k l"), (4, None), (5, "é é z"), (6, "é É z"), (6, "é É z"), (None, "one two")], "doc_id long, text string")
    got = sorted(((r.row.doc_id or 0), r.n_words, tuple(r.hits), tuple(r["items"])) for r in decontaminate.decontaminate(docs, bench).collect())
    ten = tuple(range(10))
    assert got == [(0, 2, (0, 1), ("1",)), (1, 4, (1, 2), ("1",)), (2, 10, ten, ("2",)), (3, 11, ten, ("2",)), (4, 0, (), ()), (5, 3, (), ()), (6, 3, (0, 1, 2), ()), (6, 3, (0, 1, 2), ())]
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("size(hits) > 0").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    plain = decontaminate.decontaminate(docs, bench, broadcast_bytes=0).filter("size(hits) > 0").count()
    assert plain == 6


def test_near_classes(spark, rows):
    got = {r.doc_id: r.class_id for r in registry.QUERIES["op9_bagminhash"](spark, SF).collect()}
    assert got == brute.near_classes(rows)


def test_near_large_group(spark):
    """One bucket of many near copies, of which some are far from its smallest member."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(150)]
    data = []
    for i in range(70):
        w = list(words)
        for _ in range(2):
            w[r.randrange(150)] = f"x{r.randrange(10**9)}"
        data.append((i, " ".join(w)))
    data += [(100 + i, " ".join(f"y{i}_{j}" for j in range(40))) for i in range(5)] + [(200, None), (201, ""), (202, "a b"), (203, "a b"), (203, "a b")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {x.row.doc_id: x.class_id for x in neardup.mark_near(df).collect()}
    assert got == brute.near_classes(dict(data).items())


def test_near_crowd_of_clusters(spark):
    """A template's many texts share buckets, but only those of one cluster are near: none of their links is lost."""
    r = random.Random(8)
    base, data = [f"w{i}" for i in range(160)], []
    for c in range(45):
        own = list(base)
        for at in r.sample(range(160), 5):
            own[at] = f"c{c}_{at}"
        for k in range(3):
            w = list(own)
            w[r.randrange(160)] = f"x{c}_{k}"
            data.append((len(data), " ".join(w)))
    r.shuffle(data)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {x.row.doc_id: x.class_id for x in neardup.mark_near(df).collect()}
    assert got == brute.near_classes(data)


def test_bagminhash_is_unbiased():
    r = random.Random(1)
    a = [f"t{r.randrange(40)}" for _ in range(60)]
    pairs = [(a, a[:45] + [f"u{i}" for i in range(15)]), (["z"] * 30, ["z"] * 10), (a, a)]
    for x, y in pairs:
        data, offsets = common.flat(pa.array([" ".join(x), " ".join(y)]))
        owner, value, count = neardup.bags(data, offsets, 1)
        s = neardup.bagminhash(owner, value, count, 2, 4000)
        from collections import Counter

        p, q = Counter(x), Counter(y)
        want = sum((p & q).values()) / sum((p | q).values())
        assert abs((s[0] == s[1]).mean() - want) < 0.04


def test_components(spark):
    r = random.Random(9)
    links = [(i, i + 1) for i in range(0, 60) if i % 7] + [(r.randrange(100, 140), r.randrange(100, 140)) for _ in range(25)]
    make = lambda x: {"d": x, "h": 0}
    df = spark.createDataFrame([(make(a), make(b)) for a, b in links], "a struct<d:long,h:long>, b struct<d:long,h:long>")
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        lo, hi = sorted((top(a), top(b)))
        up[hi] = lo
    got = {x.id.d: x["class"].d for x in neardup.components(df).collect()}
    assert got == {x: top(x) for a, b in links if a != b for x in (a, b)}


def test_chat(spark):
    data = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 5, "user", "hi"), (3, 7, "bot", "yo"), (3, 9, "user", None), (4, 0, None, None), (4, 0, None, None), (5, 0, "user", "solo"), (6, 0, "user", "solo"), (None, 0, "a", "b")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat.maximal(df).collect()}
    assert got == {3: (3, 1), 4: (1, 1), 5: (1, 2), None: (1, 1)}
    assert chat.maximal(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(registry.SQL[name])
    names = [c[0] for c in found.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(str(r[n]) for n in names) for r in df.collect())
    assert got == sorted(tuple(map(str, r)) for r in found.fetchall())


def test_held_out_rule(spark):
    got = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", lm.held_out().alias("o")).collect()
    assert all(r.o == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in got)


def line_docs(spark, n=60):
    r = random.Random(11)
    runs = [[f"run {k} line {i}" for i in range(r.randint(2, 6))] for k in range(12)]
    texts = []
    for i in range(n):
        lines = [f"own {i} {j}" for j in range(r.randint(1, 8))]
        for run in r.sample(runs, r.randint(0, 3)):
            at = r.randint(0, len(lines))
            lines[at:at] = run if r.random() < 0.6 else run[: r.randint(1, len(run))]
        texts.append("\n".join(lines + ["common line"] * (r.random() < 0.5)))
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_line_dedup_selects_and_extends(spark):
    texts, df = line_docs(spark)
    got = [x.text for x in sorted(linededup.dedup_lines(df).collect(), key=lambda x: x.row.doc_id)]
    assert got == brute.dedup_lines(texts)
    data, offsets = common.flat(pa.array(texts))
    x = linededup.positions(data, offsets, 2)
    lines = sum(len(t.split("\n")) for t in texts)
    assert len(x.owner) < 0.8 * lines and len(x.first) == lines - len(texts)  # fewer positions than lines; each window is one extension of its selected line


def test_line_dedup_needs_its_selection(spark, monkeypatch):
    """With lines selected by place instead of by digest, runs that begin at an odd place meet none at an even one."""
    texts, df = line_docs(spark)

    def by_place(values, owner, w):
        at = np.flatnonzero(owner[: len(owner) - w + 1] == owner[w - 1 :])
        number = np.arange(len(owner)) - np.searchsorted(owner, owner)
        return at, np.where(number[at] % 2 == 0, at, at + 1)

    # Texts unlike in their selected lines have nothing to extend, so what repeats once only is missed.
    pairs = [f"own {i}\n" * (i % 2) + f"a {i // 2}\nb {i // 2}" for i in range(20)]
    data, offsets = common.flat(pa.array(pairs))
    right = linededup.positions(data, offsets, 2)
    monkeypatch.setattr(linededup, "winnow", by_place)
    wrong = linededup.positions(data, offsets, 2)
    assert right.line.tolist() != wrong.line.tolist()
    shared = lambda x: sum(n > 1 for n in np.unique(x.line, return_counts=True)[1])
    assert shared(right) >= 10 > shared(wrong)


def test_html_names_after_no_and_has():
    page = '<html><body><div class="content">%s<p>{}</p><p>{}</p></div></body></html>'.replace("{}", "Plain sentences of an article, long enough to be its text. " * 4)
    for said in ('class="comments no-print"', 'class="has-comments comments"', 'class="menu has-sub"', 'class="sidebar no-print"', 'id="cookie-notice" class="with-border"'):
        assert "reader" not in html.main_text(page % f"<div {said}><p>reader says so, at some length, to all the others who read it</p></div>"), said
    for said in ('class="has-sidebar"', 'class="no-comments"', 'class="body without-ads"'):
        assert "reader" in html.main_text(page % f"<div {said}><p>reader says so, at some length, to all the others who read it</p></div>"), said


def test_html_heading_in_deep_elements():
    p = "<p>%s</p>" % ("Plain sentences of an article, long enough to be its text. " * 4)
    page = f"<html><body><h1><span><a href='#'><b><i><em>The title</em></i></b></a></span></h1>{p * 3}</body></html>"
    assert html.main_text(page).startswith("The title")


def test_sets_of_documents_in_company_need_no_shuffle_of_texts(spark):
    from mailsift.llm import neardup
    from mailsift.llm.common import keyed

    docs = spark.createDataFrame([(i, " ".join(f"w{i + j}" for j in range(12))) for i in range(40)], "doc_id long, text string")
    rows = keyed(docs)
    ids = rows.filter("_d % 4 = 0").select(F.struct(F.col("_d").alias("d"), F.col("_h").alias("h")).alias("id"))
    sets = neardup.shingle_sets(rows.union(rows), ids)
    got = {r.id.d: sorted(r.items) for r in sets.collect()}
    assert sorted(got) == list(range(0, 40, 4)) and all(len(x) == 8 for x in got.values()) and set(got[0]) & set(got[4])
    assert sets.count() == 10 and neardup.shingle_sets(rows, ids.filter("false")).count() == 0
    assert sum(bin(int(x)).count("1") for x in neardup.marks(ids)) == 10
