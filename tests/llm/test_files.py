"""Pages, token files, the range coder, the pipeline and SQL."""

import random
import time
import zlib
from pathlib import Path

import numpy as np
import pytest

from sparkvane.llm import pages, range_coder, token_files
from sparkvane.llm.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize(("n", "lanes", "vocab", "kind"), [(0, 4, 10, "u"), (1, 4, 10, "u"), (5, 8, 300, "u"), (5000, 64, 50257, "u"), (20000, 256, 50257, "z"), (3000, 16, 2, "c"), (4097, 1, 1000, "z")])
def test_range_coder_round_trip(n, lanes, vocab, kind):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, vocab, n) if kind == "u" else (rng.zipf(1.3, n) % vocab) if kind == "z" else np.ones(n, int)
    block = range_coder.encode(ids, lanes, vocab)
    assert (range_coder.decode(block) == ids).all()
    if kind == "c":
        assert len(block) < n / 2


def test_broken_blocks():
    block = range_coder.encode(np.arange(1000) % 37, 8, 50)
    for bad in (block[:-1], b"x" + block[1:], block[:60] + bytes([block[60] ^ 1]) + block[61:]):
        with pytest.raises(ValueError):
            range_coder.decode(bad)
    payload = token_files.pack([1, 2], [3, 4], np.arange(7), 50)
    with pytest.raises(ValueError):
        token_files.unpack(payload[:20] + bytes([payload[20] ^ 1]) + payload[21:])


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer()
    rnd = random.Random(0)
    texts = ["", "a", " a  b\n\nc\t d ", "it's we'LL 12 3a!?", "naïve Éé ü—dash", "日本 <|endoftext|> x", "Abc\nDef ghi", "x" * 3000] + ["".join(rnd.choice("ab é\n.'1,   ") for _ in range(200)) for _ in range(50)]
    t = Tokenizer.from_file(path)
    e = token_files.Encoder(path)
    for _ in range(2):
        assert [x.tolist() for x in e(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_encoding_and_coding_take_less_than_the_library_alone():
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()]
    e = token_files.Encoder(token_files.default_tokenizer())
    began = time.process_time()
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    library = time.process_time() - began
    e(texts)  # the frequent words, which a worker keeps
    began = time.process_time()
    got = e(texts)
    ids = np.concatenate(got)
    back = range_coder.decode(range_coder.encode(ids, token_files.LANES, e.vocab))
    took = time.process_time() - began
    assert [x.tolist() for x in got] == want and (back == ids).all()
    assert took < 0.6 * library, (took, library)


def test_pre_tokens_follow_the_library():
    rnd = random.Random(3)
    e = token_files.Encoder(token_files.default_tokenizer())
    texts = ["", "\0", "a\0b", "'sa're're", "''s", "x'", "'l", " 's", "a  ", "×÷¨ɐ", "a<|b", "’s"] + ["".join(rnd.choice("ab é\n\t.'1,  smtdrevl'¡§ñɏ_A") for _ in range(n)) for n in (3, 8, 40) for _ in range(200)]
    want = [e.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert [x.tolist() for x in e(texts)] == want
    assert [e([x])[0].tolist() for x in texts[:100]] == want[:100]


def test_like_strings_stay_apart():
    strings = [b"a", b"b", b"a", b"", b"12345678", b"123456789", b"12345678abcdefgh", b"12345678Xbcdefgh", b"12345678abcdefghi", b"12345678abcdefgh", b"x" * 40, b"x" * 39 + b"y", b"x" * 40]
    ends = np.cumsum([len(s) for s in strings])
    one, which = token_files.alike(b"".join(strings) + bytes(8), ends - [len(s) for s in strings], ends)
    assert [strings[k] for k in one[which]] == strings and len(one) == len(set(strings))


def test_only_hidden_elements_are_hidden():
    for tag in ('class="overflow-hidden"', 'style="overflow:hidden"', 'class="hidden-print"', 'title="a hidden gem"', "data-hidden=1", 'aria-hidden="false"', 'hidden="until-found"', 'title="display:none"', 'data-aria-hidden="true"', 'title="no > end"'):
        assert [t for _, t, _ in pages.blocks(f"<div {tag}><p>text</p></div>")] == ["text"], tag
    for tag in ("hidden", "HIDDEN", 'hidden=""', 'class="a" hidden', "aria-hidden=true", 'style="color:red; display : none"', "style='DISPLAY:NONE !important'"):
        assert pages.blocks(f"<div {tag}><p>text</p></div>") == [], tag


def _on(path, name):
    return pages._slot({}, name, pages.PATH_BUCKETS) in np.frombuffer(path, np.int16)


def test_late_names_and_characters_count():
    path, text, _ = pages.blocks(f'<div class="{" ".join(["x"] * 40)} sidebar"><p>{"word " * 60}| more</p></div>')[0]
    assert _on(path, "sidebar")
    assert pages.Inputs([(path, text, 0)]).plain[0, 6] == 1 and pages.Inputs([(path, text.replace("|", ""), 0)]).plain[0, 6] == 0


def test_token_files(spark, docs, odd_rows, tmp_path):
    from tokenizers import Tokenizer

    path = str(tmp_path / "t")
    token_files.write(docs(odd_rows), path, token_files.default_tokenizer(), block_ids=500)
    got = token_files.read_ids(spark, path, with_ids=True).orderBy("start").collect()
    t = Tokenizer.from_file(token_files.default_tokenizer())
    want = {}
    for i, text in odd_rows:
        want.setdefault(i, []).append([*t.encode(text or "", add_special_tokens=False).ids, 2])
    at = 0
    assert [r.doc_id for r in got] == sorted((i for i, _ in odd_rows), key=lambda i: (i is not None, i or 0))
    for r in got:
        assert r.ids in want[r.doc_id] and r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert token_files.token_files(docs([])).count() == 0


def test_blocks_of_a_page():
    page = '<html><head><title>T</title><style>p{}</style></head><body><!-- no --><nav><ul><li><a href="/x">One</a><li>Two</ul></nav><article class="post entry"><h1>A &amp; B</h1><p><b>bold<br>more\n text<p>next <i>it</i>alic</p><script>var t="</p>";</script><div hidden>gone</div></article><footer>&copy; x</footer>'
    got = pages.blocks(page)
    assert [t for _, t, _ in got] == ["One", "Two", "A & B", "bold more text", "next italic", "© x"]
    assert _on(got[2][0], "entry") and _on(got[0][0], "nav") and not _on(got[2][0], "nav") and got[0][2] == 3
    assert pages.blocks(None) == pages.blocks("") == pages.blocks("<p>") == []
    assert [t for _, t, _ in pages.blocks("plain < text & more")] == ["plain < text & more"]


def test_deep_and_long_pages_are_read_in_linear_time():
    deep = "<article>" + "".join(f'<div class="k{k}">x{k}' for k in range(20_000))
    began = time.perf_counter()
    got = pages.blocks(deep)
    assert [t for _, t, _ in got] == [f"x{k}" for k in range(20_000)]
    for odd in ("<p><i>" + "<b>" * 20_000 + "</i>x" * 20_000, "<div>" * 20_000 + "</p>x" * 20_000, "<li>x" * 20_000, "<div><p>x" * 20_000):
        pages.blocks(odd)
    assert time.perf_counter() - began < 30
    for n in (5000, 20_000):
        assert len(pages.Labeller(0).predict([pages.Inputs(got[:n])])[0]) == n
    # Steps and slots that are read in parts give what they give at once.
    model, some = pages.Labeller(3), [pages.Inputs(pages.blocks(p)) for p in pages.sample_pages(6, 2)]
    whole = model.predict(some)
    kept, pages.STEPS_AT_ONCE, pages.SLOTS_AT_ONCE = (pages.STEPS_AT_ONCE, pages.SLOTS_AT_ONCE), 7, 20
    parts = model.predict(some)
    pages.STEPS_AT_ONCE, pages.SLOTS_AT_ONCE = kept
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(whole, parts, strict=True))


#: Pages that the generator did not make, with the blocks that are their main text, told by hand.
BY_HAND = [
    ("""<!doctype html><html><head><title>The long walk</title><link rel=stylesheet href=a.css></head><body class="home">
<header><a href="/"><img src=logo.png alt=Logo>Hill &amp; Dale</a><nav aria-label=main><ul><li><a href=/news>News</a><li><a href=/walks>Walks</a><li><a href=/shop>Shop</a></ul></nav></header>
<div class="cookie-consent"><p>We use cookies to improve your visit.</p><button>Accept</button></div>
<main><article class="story"><h1>The long walk</h1><p>We left before dawn, when the valley was still grey, and did not stop until the first hut.
<p>Rain.</p><p>It fell for an hour&nbsp;and then the sun came out over the ridge &mdash; the whole range lay open before us.</p>
<aside class="related"><h3>Related</h3><ul><li><a href=/w/2>A short walk</a></li><li><a href=/w/3>A night walk</a></li></ul></aside>
<h2>The descent</h2><p>Going down was harder than going up, as it always is.</p></article></main>
<section id="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>Lovely, thank you for this report!</p></div><div class="comment"><b>Bo</b><p>I was there last year.</p></div></section>
<footer><p>&copy; 2021 Hill &amp; Dale. All rights reserved.</p></footer></body></html>""",
     ["The long walk", "We left before dawn, when the valley was still grey, and did not stop until the first hut.", "Rain.", "It fell for an hour and then the sun came out over the ridge — the whole range lay open before us.", "The descent", "Going down was harder than going up, as it always is."]),
    ("""<html><body><div id=wrapper><div id=nav><a href=1>Start</a> | <a href=2>Archiv</a> | <a href=3>Kontakt</a></div>
<div class="post-content"><h2>Ein Brief</h2><p>Der Brief kam am Montag, und niemand wusste, wer ihn geschrieben hatte.</p><blockquote><p>Kommt sofort.</p></blockquote>
<ul><li>Erstens war er ohne Namen.</li><li>Zweitens war er sehr kurz.</li></ul><script>show("<p>no</p>")</script><p>Wir fuhren los.</p></div>
<div class="sidebar"><h4>Neueste</h4><a href=5>Ein Fest</a> <a href=6>Ein Spiel</a></div><form class=search><label>Suche</label><input name=q></form>
<div id=footer>Impressum &middot; Datenschutz</div></div></body></html>""",
     ["Ein Brief", "Der Brief kam am Montag, und niemand wusste, wer ihn geschrieben hatte.", "Kommt sofort.", "Erstens war er ohne Namen.", "Zweitens war er sehr kurz.", "Wir fuhren los."]),
]


def test_pages_told_by_hand():
    for page, want in BY_HAND:
        found = pages.blocks(page)
        got = pages.trained().predict([pages.Inputs(found)])[0]
        assert [t for (_, t, _), y in zip(found, got, strict=True) if y >= 0.5] == want


def test_gradients_are_right():
    inputs, labels = zip(*(pages.labelled(p) for p in pages.sample_pages(3, 1)), strict=True)
    m, side = pages.Labeller(0, np.float64), pages.Pages(list(inputs), list(labels))
    g, _ = m.gradients(side)
    rng = np.random.default_rng(0)
    for k in ("path", "word", "w", "u", "o", "v", "c"):
        v = m.p[k]
        where = np.unravel_index(np.argsort(-np.abs(g[k]).ravel())[rng.integers(0, 5)], v.shape) if v.size > 5 else (0,) * v.ndim
        old, out = v[where], []
        for d in (1e-5, -1e-5):
            v[where] = old + d
            out.append(m.gradients(side)[1])
        v[where] = old
        assert abs((out[0] - out[1]) / 2e-5 - g[k][where]) < 1e-6


def test_pages(spark):
    held = [pages.labelled(p) for p in pages.sample_pages(100, 5)]
    got = pages.trained().predict([x for x, _ in held])
    assert np.mean(np.concatenate([(y >= 0.5) == t for y, (_, t) in zip(got, held, strict=True)])) > 0.995
    rows = [(1, "u", "<nav><a href=/>menu</a></nav><article><h1>Title words</h1><p>Some long text of the article, with words.</p></article><footer>© 2020 site</footer>"), (2, None, None), (3, "u", ""), (None, "u", "<p>"), (1, "u", "<article><p>Some long text of the article, with words.</p></article>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    out = pages.extract(df).collect()
    assert len(out) == 5
    assert ("Title words\nSome long text of the article, with words." in {r.text for r in out}) and all(r.n_chars == len(r.text) for r in out)
    assert [r.text for r in out if r.page_id in (2, 3, None)] == ["", "", ""]
    assert pages.extract(df.limit(0)).count() == 0
    # The second session reads the weights that the first one kept.
    again = pages.kept(spark)
    assert again is not pages.trained() and all((v == pages.trained().p[k]).all() for k, v in again.p.items())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
class TestTables:
    @pytest.mark.parametrize("name", sorted(ORACLE_SQL))
    def test_sql(self, spark, name):
        import duckdb

        con = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        got = QUERIES[name](spark, str(DATA))
        want = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns)
        order = sorted(names)
        assert sorted(repr(tuple(r[c] for c in order)) for r in got.collect()) == sorted(repr(tuple(r[names.index(c)] for c in order)) for r in want.fetchall())

    def test_pipeline(self, spark):
        """The pipeline's documents by plain versions of its stages."""
        import corpus_pipeline
        from tokenizers import Tokenizer

        from sparkvane.llm import decontamination, jaccard, language, mixing

        docs = [r.asDict() for r in spark.read.parquet(str(DATA / "documents.parquet")).collect()]
        docs = [d for d in docs if d["text"] and language.LETTERS.search(d["text"])]
        sets = {d["doc_id"]: {tuple(w[k : k + 5]) for w in [jaccard.WORD.findall(d["text"].lower())] for k in range(max(1, len(w) - 4))} for d in docs}
        least = {i: i for i in sets}
        for a in sorted(sets):
            for b in sorted(sets):
                if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    low = min(least[a], least[b])
                    least = {k: low if v in (least[a], least[b]) else v for k, v in least.items()}
        docs = [d for d in docs if least[d["doc_id"]] == d["doc_id"]]
        items = [decontamination.words(r.text) for r in spark.read.parquet(str(DATA / "benchmark.parquet")).collect()]

        def leaked(text):
            w = " ".join(decontamination.words(text))
            return any(" ".join(i) in w for i in items)

        docs = [d for d in docs if not leaked(d["text"])]
        chances = {r.doc_id: r.kept for r in mixing.mix(spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], d["source"]) for d in docs], "doc_id long, text string, lang string, source string")).collect()}
        docs = sorted((d for d in docs if chances[d["doc_id"]]), key=lambda d: d["doc_id"])
        t, at, want = Tokenizer.from_file(token_files.default_tokenizer()), 0, []
        for d in docs:
            n = len(t.encode(d["text"], add_special_tokens=False).ids) + 1
            want.append((d["doc_id"], at, n))
            at += n
        got = corpus_pipeline.run(spark, str(DATA)).orderBy("doc_id").collect()
        assert [(r.doc_id, r.start, r.n_tokens) for r in got] == want
        assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "mixing", "token_files"]
