"""Operators that read each text once, against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as PT
import pytest

from rowloom.llm import bytebpe, bytecnn, fertility, labelled, licenses, toxicity, winnowing
from rowloom.llm.textbytes import Run

RANKS = PT.path("byte_bpe_multi_50k.tiktoken")
PIECES = PT.path("piece_bpe_32k.model")


def words(text, pattern=rb"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").encode())


def random_text(rng, vocabulary, n):
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", ", "]) for _ in range(n))


# byte-level BPE


def library_encoder():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PT.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bytebpe.load_ranks(RANKS))}, special_tokens={})


def test_bpe_equals_rank_bpe():
    bpe, want, rng = bytebpe.loaded(RANKS, PT.PATTERN), library_encoder(), random.Random(1)
    pools = [range(32, 127), range(0, 0x250), [*range(0x400, 0x460), *range(0x4E00, 0x4E20), 0x1F600, 10, 32, 0, 0x85, 0xA0, 0x2003]]
    for i in range(300):
        text = "".join(chr(rng.choice(pools[i % 3])) for _ in range(rng.randrange(80)))
        ids = bpe.encode(text)
        assert ids == want.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_bpe_every_token_is_its_piece():
    bpe = bytebpe.loaded(RANKS, PT.PATTERN)
    assert all(bpe.model.encode(bytebpe.to_chars(t)) == [i] for i, t in enumerate(bpe.tokens[:5000]))
    assert bytebpe.to_bytes(bytebpe.to_chars(bytes(range(256)))) == bytes(range(256))


def test_bpe_documents(hard_docs, no_docs):
    want = library_encoder()
    got = bytebpe.encode_documents(hard_docs, RANKS, PT.PATTERN, with_ids=True).collect()
    texts = [r.text or "" for r in hard_docs.collect()]
    assert sorted((r.n_tokens, r.ids_sha256) for r in got) == sorted((len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()) for i in map(want.encode_ordinary, texts))
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert all(r.round_trip for r in got)
    assert bytebpe.encode_documents(no_docs, RANKS, PT.PATTERN).collect() == []


# winnowing


def plain_hits(text, items, window=10):
    word = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    w = word(text)
    hit, found = set(), set()
    for item, t in items:
        v = word(t)
        n = min(window, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontaminate(spark, make_docs, block_bytes):
    rng = random.Random(3)
    vocabulary = ["a", "b", "C", "d1", "é", "the", "of"]
    items = [(str(i), random_text(rng, vocabulary, rng.choice([0, 1, 4, 9, 10, 11, 30]))) for i in range(25)] + [("0", None), ("7", "a repeated id with other words in it")]
    docs = [random_text(rng, vocabulary, rng.randrange(60)) + (rng.choice(items)[1] or "") + random_text(rng, vocabulary, 5) for _ in range(60)] + [None, "", "Of THE of"]
    docs = [(i, t) for i, t in enumerate(docs)] + [(3, docs[3])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = winnowing.decontaminate(make_docs(docs), bench, block_bytes=block_bytes).collect()
    want = [(i, *plain_hits(t, items)) for i, t in docs]
    assert sorted(map(tuple, got)) == sorted(want)
    kept = winnowing.drop_contaminated(make_docs(docs), bench, block_bytes=block_bytes).collect()
    assert sorted(r.doc_id for r in kept) == sorted(w[0] for w in want if not w[-1])


def test_decontaminate_long_windows(spark, make_docs):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(str(i), random_text(rng, vocabulary, 25)) for i in range(20)]
    docs = [random_text(rng, vocabulary, 30) + " " + " ".join(rng.choice(items)[1].split()[rng.randrange(10) :][: rng.randrange(8, 14)]) + " " + random_text(rng, vocabulary, 30) for _ in range(100)]
    got = winnowing.decontaminate(make_docs(docs), spark.createDataFrame(items, "item_id string, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((i, *plain_hits(t, items)) for i, t in enumerate(docs))


def test_decontaminate_hard(spark, hard_docs, no_docs):
    bench = spark.createDataFrame([(None, "word word word word word word word word word word word"), ("1", "same row")], "item_id string, text string")
    got = winnowing.decontaminate(hard_docs, bench).collect()
    assert sorted((r.n_words, r.n_hit, r.n_items) for r in got) == [(0, 0, 0)] * 3 + [(4, 2, 1), (4, 2, 1), (5, 0, 0), (10, 0, 0), (30_000, 30_000, 1)]
    assert winnowing.decontaminate(no_docs, bench).collect() == []
    assert not any(r.contaminated for r in winnowing.decontaminate(hard_docs, bench.limit(0)).collect())


# quality rules


def plain_base(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    repeat = {i + j for i, t in enumerate(tri) if tri.count(t) > 1 for j in range(3)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), dup, len(repeat), len(w) < 50 or 100 * len(repeat) > 50 * len(w)


def test_quality_base(make_docs):
    rng = random.Random(5)
    texts = [random_text(rng, ["a", "b", "of", "é|", "漢#", "x\x1cy\x85z"], rng.randrange(120)) for _ in range(60)] + [None, "", "a\na\n\nb\na", " \n "]
    got = fertility.quality_rules(make_docs(texts), RANKS, PIECES).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == [(i, *plain_base(t)) for i, t in enumerate(texts)]
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_fertility(make_docs):
    import math
    from collections import Counter

    import sentencepiece

    text = " ".join(f"plain words number {i} of an ordinary text" for i in range(20)) + " 漢字 ꙮꙮ"
    row = fertility.quality_rules(make_docs([text]), RANKS, PIECES).first()
    bpe, sp = library_encoder(), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    tokens = [t for w in text.split() for t in bpe.encode_ordinary(" " + w)]
    pieces = [p for w in text.split() for p in sp.encode(w)]
    assert row.n_tokens == len(tokens)
    assert row.chars_per_token == pytest.approx(sum(map(len, text.split())) / len(tokens))
    assert row.fallback_share == pytest.approx(sum(map(sp.is_byte, pieces)) / len(pieces))
    assert row.token_entropy == pytest.approx(-sum(c / len(tokens) * math.log2(c / len(tokens)) for c in Counter(tokens).values()))
    junk = " ".join(f"{w}$$$" if i % 2 else f"{w}%%%" for i, w in enumerate("qx zv jk wq xz".split() * 40 + [str(i) for i in range(200)]))
    assert not fertility.quality_rules(make_docs([junk]), RANKS, PIECES).first().kept


def test_quality_hard(hard_docs, no_docs):
    got = fertility.quality_rules(hard_docs, RANKS, PIECES).collect()
    assert len(got) == 8 and all(r.base_failed and not r.kept for r in got)
    assert fertility.quality_rules(no_docs, RANKS, PIECES).collect() == []


def test_scripts():
    texts = {"latin": "plain é", "cyrillic": "русский текст", "greek": "ελληνικά", "kana": "漢字かな漢字", "han": "漢字", "hangul": "한국어", "thai": "ภาษาไทย", "arabic": "العربية", "hebrew": "עברית", "devanagari": "हिन्दी", "other": "ꙮꙮꙮ"}
    assert {k: fertility.script(t) for k, t in texts.items()} == {k: k for k in texts}
    assert fertility.script("") == "latin"


def test_fitted_bands(make_docs, hard_docs, no_docs):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    stems = ["дом", "река", "книга", "город", "читать", "новый", "вечер", "работа", "писать", "слово"]
    texts = [" ".join(rng.choice(stems) + rng.choice(["", "ы", "ами", "ного", "ть"]) for _ in range(200)) for _ in range(60)]
    docs = make_docs(texts).withColumn("lang", F.lit(None).cast("string"))
    bands = fertility.fit_bands(docs, RANKS, PIECES, least_rows=50)
    assert set(bands) == {"cyrillic"}
    measured = fertility.quality_rules(docs, RANKS, PIECES, fertility.BANDS | bands).collect()
    passed = [r for r in measured if not r.base_failed]
    assert len(passed) >= 50 and {r.band for r in passed} == {"cyrillic"} and all(r.kept for r in passed)
    chars = sorted(r.chars_per_token for r in passed)
    assert bands["cyrillic"].least_chars == pytest.approx(0.97 * chars[0], abs=0.02) and bands["cyrillic"].most_chars == pytest.approx(1.03 * chars[-1], abs=0.02)
    # The wide band of other scripts lets junk pass; the fitted one doesn't.
    junk = make_docs([" ".join("".join(rng.choice("щъыэюяф") for _ in range(6)) for _ in range(200))]).withColumn("lang", F.lit(None).cast("string"))
    assert fertility.quality_rules(junk, RANKS, PIECES).first().kept
    assert not fertility.quality_rules(junk, RANKS, PIECES, fertility.BANDS | bands).first().kept
    assert fertility.fit_bands(hard_docs, RANKS, PIECES, least_rows=1) == {} == fertility.fit_bands(no_docs, RANKS, PIECES)


# licences


def test_licences(make_docs, hard_docs, no_docs):
    for name, text in licenses.TEMPLATES.items():
        lines = text.replace(". ", ".\n")
        row = licenses.scan_licences(make_docs([f"Some words here.\n{lines}\nother words"])).first() if name in ("MIT", "BSD-3-Clause") else None
        if row:
            assert row.licences == name and row.n_licences == 1
    got = licenses.scan_licences(make_docs(["Released under the MIT License.", "the text\nLicensed under CC BY-NC 4.0.\nmore\nmore\nmore\nmore\nReleased under the MIT License.", "A licence of no known kind.", "nothing"])).orderBy("doc_id").collect()
    assert [r.licences for r in got] == ["MIT-notice", "CC-BY-NC-4.0-notice,MIT-notice", "", ""]
    assert [r.n_blocks for r in got] == [1, 2, 1, 0]
    assert all(r.n_licences == 0 for r in licenses.scan_licences(hard_docs).collect())
    assert licenses.scan_licences(no_docs).collect() == []


def test_licence_brute_force():
    """All templates at all places, by exact words, against the scan."""
    templates, alone = licenses._compressors(tuple(sorted(licenses.TEMPLATES.items())))
    rng = random.Random(6)
    for _ in range(30):
        picked = [rng.choice(list(licenses.TEMPLATES)) for _ in range(rng.randrange(3))]
        lines = []
        for name in picked:
            lines += ["plain words of a text"] * rng.randrange(4, 7) + [licenses.TEMPLATES[name]]
        found = [f[0] for f in licenses.scan_text("\n".join(lines), templates, alone)]
        assert found == [n.split("/")[0] for n in picked]


def test_licence_copies_of_one_block():
    """Copies with and without a changed word, one after the other."""
    templates, alone = licenses._compressors(tuple(sorted(licenses.TEMPLATES.items())))
    for name in ("ISC", "MIT", "GPL-3.0"):
        exact = licenses.TEMPLATES[name]
        changed = exact.replace("software", "material", 1) if name == "ISC" else exact.replace("free", "gratis", 1)
        for copies in ((exact, exact), (exact, changed), (changed, exact), (changed, changed), (changed, exact, changed)):
            found = licenses.scan_text("\n".join(copies), templates, alone)
            assert [f[:3] for f in found] == [(name, i, i) for i in range(len(copies))]
            assert [f[4:6] for f in found] == [(0, 0) if c == exact else (1, 1) for c in copies]


#: Paragraphs and line widths of the published texts; the others are one paragraph.
PARAGRAPHS = {"MIT": ("The above",), "Apache-2.0": ("You may obtain", "http:", "Unless"), "GPL-3.0": ("This program is distributed",), "BSD-3-Clause": ("Redistributions of", "Redistributions in", "Neither")}


@pytest.mark.parametrize("width", [20, 60, 72, 78])
@pytest.mark.parametrize("name", sorted(licenses.TEXTS))
def test_licences_wrapped(name, width):
    """Each template in lines, with blank lines between paragraphs, comment marks and text around."""
    import textwrap

    templates, alone = licenses._compressors(tuple(sorted(licenses.TEMPLATES.items())))
    text = licenses.TEMPLATES[name]
    for start in PARAGRAPHS.get(name, ()):
        text = text.replace(" " + start, "\n" + start)
    body = "\n\n".join(textwrap.fill(x, width, break_long_words=False, break_on_hyphens=False) for x in text.split("\n"))
    around = "\n".join(["Copyright (c) 2020 of the authors", "", "{}", "", *["the words of this text and of any others are here"] * 40])
    for mark in ("", "# ", " * "):
        lines = around.format(body).split("\n")
        found = licenses.scan_text("\n".join(mark + x for x in lines), templates, alone)
        n = len(body.split("\n"))
        assert [(*f[:3], *f[4:]) for f in found] == [(name, 2, 1 + n, 0, 0, "")]


def test_licence_notices_and_wording():
    """Versions and kinds are told apart by a word; the differences are the words themselves."""
    templates, alone = licenses._compressors(tuple(sorted(licenses.TEMPLATES.items())))
    names = lambda text: [f[0] for f in licenses.scan_text(text, templates, alone)]
    assert names("Available under the GNU Lesser General Public License, version 2.1 or later.") == ["LGPL-2.1-notice"]
    assert names("under the terms of the GNU General Public License, version 2") == ["GPL-2.0-notice"]
    assert names("under the terms of the GNU General Public License, version 9") == []
    assert names("This page is available under the Creative Commons Attribution-ShareAlike 3.0 Unported License.") == ["CC-BY-SA-3.0-notice"]
    changed = licenses.TEXTS["ISC"].replace("granted", "given").replace("in all copies", "in copies")
    (found,) = licenses.scan_text(changed, templates, alone)
    assert found[0] == "ISC" and found[4:6] == (2, 1) and sorted(found[6].split()) == ["+given", "-all", "-granted"]


# toxicity


#: Words of the tests alone: the chain has no word list.
BAD = ("grolsk", "vumptik", "zerrund", "vequa", "vequo")


def toxic_rows(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = [rng.choice(["the", "of", "and", "thin", "ered", "onth"]) + rng.choice(["", "er", "ing"]) for _ in range(40)]
        bad = rng.random() < 0.3
        if bad:
            w[rng.randrange(40)] = rng.choice(BAD)
        out.append((" ".join(w), int(bad)))
    return out


def plain_chain(chain, text):
    """Probabilities by the definition: words and word beginnings, one text, one model after another."""
    out = []
    words = {w for w in re.findall("[a-z\x80-\xff]+", text.encode().decode("latin-1").translate({c: c + 32 for c in range(65, 91)}))}
    numbers = {int(v) for w in words for v in toxicity.features(Run(0, 1, np.frombuffer(w.encode("latin-1"), np.uint8), np.array([0, len(w)])))[1]}
    for model in chain.models:
        logit = model.bias + sum(w for f, w in zip(model.features.tolist(), model.weights.tolist(), strict=True) if f in numbers)
        logit += sum(w * p for w, p in zip(model.earlier.tolist(), out, strict=True))
        out.append(1 / (1 + math.exp(-min(30, max(-30, logit)))))
    return out


def test_toxicity_chain(spark, make_docs, hard_docs, no_docs):
    train, test = toxic_rows(600, 1), toxic_rows(200, 2)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(train)] + [(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    chain = toxicity.train(make_docs([t for t, _ in train]), labels)
    assert [len(m.earlier) for m in chain.models] == [0, 1, 2, 3]
    texts = [t for t, _ in test] + ["", "Grölsk GROLSK\n" * 3, "x" * 5000]
    got = {r.doc_id: r for r in toxicity.score_documents(make_docs(texts), chain).collect()}
    assert np.mean([got[i].predicted == y for i, (_, y) in enumerate(test)]) > 0.97
    for i, t in enumerate(texts):
        assert np.allclose([got[i].p_kind_1, got[i].p_kind_2, got[i].p_kind_3, got[i].score], plain_chain(chain, t), atol=1e-9)
        assert got[i].rejected == (got[i].score >= chain.threshold)
    kept = toxicity.drop_toxic(make_docs([t for t, _ in test]), chain).collect()
    assert {r.doc_id for r in kept} == {i for i in range(len(test)) if not got[i].rejected}
    hard = toxicity.score_documents(hard_docs, chain).collect()
    assert len(hard) == 8 and not any(r.rejected for r in hard)
    assert toxicity.drop_toxic(hard_docs, chain).columns == hard_docs.columns
    assert toxicity.score_documents(no_docs, chain).collect() == []


def test_toxicity_kinds():
    """The word of most toxic rows first; a word of clean rows names no kind; what remains is the last kind."""
    mark = 1 << 63
    rows = [({1, 9}, 1), ({1}, 1), ({1, 2}, 1), ({2}, 1), ({2, 9}, 1), ({2}, 1), ({9}, 1), ({9}, 0), ({9}, 0), (set(), 1)]
    text = np.array([i for i, (f, _) in enumerate(rows) for _ in f])
    value = np.array([mark | x for f, _ in rows for x in f], np.uint64)
    got = toxicity.category_labels(text, value, np.array([y for _, y in rows]))
    assert {k: v.tolist() for k, v in got.items()} == {"kind_1": [0, 0, 1, 1, 1, 1, 0, 0, 0, 0], "kind_2": [0] * 10, "kind_3": [1, 1, 0, 0, 0, 0, 1, 0, 0, 1], "toxic": [y for _, y in rows]}


def test_toxicity_without_labels(spark, make_docs):
    chain = toxicity.train(make_docs(["a", "b"]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(not r.rejected for r in toxicity.score_documents(make_docs(["a", None]), chain).collect())


# quality network


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = bytecnn.Network.fresh(rng)
    for i, part in enumerate(net.parts()):
        part[:] = rng.standard_normal(part.shape) * (0.5 if i else 1)
    raw = [np.frombuffer(("some text %d with words " % i * (3 + 20 * i)).encode(), np.uint8) for i in range(4)]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    chunks, first = bytecnn.chunks_of(np.concatenate(raw), bounds)
    y, w = np.array([0, 1, 1, 0], np.float32), np.ones(4, np.float32)
    grads = net.gradient(chunks, first, y, w)

    def loss():
        top = np.maximum.reduceat(net.chunk_features(chunks), first[:-1], axis=0)
        z = (top @ net.out + net.out_bias).astype(np.float64)
        return np.mean(np.logaddexp(0, z) - y * z)

    for part, g in list(zip(net.parts(), grads, strict=True))[1:]:
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = part[at]
        part[at] = old + 1e-3
        up = loss()
        part[at] = old - 1e-3
        down = loss()
        part[at] = old
        assert (up - down) / 2e-3 == pytest.approx(g[at], rel=0.1, abs=1e-3)


def test_network_covers_whole_text():
    data = np.arange(1000) % 251
    chunks, first = bytecnn.chunks_of(data.astype(np.uint8), np.array([0, 0, 1, 256, 257, 1000]))
    assert np.diff(first).tolist() == [1, 1, 1, 1, 4]
    assert (chunks[0] == bytecnn.PAD).all()
    last = chunks[first[4] : first[5]]
    assert last[-1][last[-1] != bytecnn.PAD][-1] == data[-1]
    assert (np.concatenate([*(c[: bytecnn.STEP] for c in last[:-1]), last[-1][last[-1] != bytecnn.PAD]]) == data[257:]).all()


def plain_network(net, text):
    """The score by the definition, one window at a time."""
    raw = text.encode()
    starts = [0]
    while starts[-1] + bytecnn.CHUNK < len(raw):
        starts.append(starts[-1] + bytecnn.STEP)
    top = np.full(bytecnn.HIDDEN, -np.inf)
    for at in starts:
        chunk = list(raw[at : at + bytecnn.CHUNK]) + [bytecnn.PAD] * (bytecnn.CHUNK - len(raw[at : at + bytecnn.CHUNK]))
        windows = [np.concatenate([net.embed[b] for b in chunk[i : i + bytecnn.WIDTH]]) @ net.filters + net.filter_bias for i in range(0, bytecnn.CHUNK - bytecnn.WIDTH + 1, bytecnn.STRIDE)]
        h = np.maximum(np.max(windows, 0), 0)
        top = np.maximum(top, np.maximum(h @ net.hidden + net.hidden_bias, 0))
    return 1 / (1 + math.exp(-float((top @ net.out + net.out_bias).item())))


def test_labelled_sample_is_bounded(spark, make_docs):
    """By rows and by all bytes together: a text that doesn't fit is passed over, whole, and others follow."""
    docs = make_docs(["a" * 100, "é" * 400, "c" * 50, None, "d" * 30])
    labels = spark.createDataFrame([(i, 1) for i in range(6)] + [(0, 1)], "doc_id long, quality int")
    got = labelled.sample(docs, labels, "quality", 10, 200)
    assert [(i, len(t)) for i, t, _ in got] == [(0, 100), (2, 50), (4, 30)]
    assert len(labelled.sample(docs, labels, "quality", 2, 10_000)) <= 2
    assert labelled.sample(docs, labels.limit(0), "quality", 10, 200) == []


def test_network_learns(spark, make_docs, hard_docs, no_docs):
    rng = random.Random(7)
    good = lambda: " ".join(rng.choice(["the", "of", "thin", "ered", "and"]) + rng.choice(["", "er", "ing"]) for _ in range(rng.randrange(20, 200)))
    texts = [good() if i % 2 else good().replace(" ", rng.choice(["$$$ ", " | ", "%%% "])) for i in range(400)]
    docs, labels = make_docs(texts), spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, quality int")
    net = bytecnn.train(docs, labels)
    got = bytecnn.score_documents(docs, net).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == r.doc_id % 2 for r in got if r.held_out]) > 0.95
    for i in (0, 1, 17):
        assert abs(next(r.score for r in got if r.doc_id == i) - plain_network(net, texts[i])) < 1e-4
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len(bytecnn.score_documents(hard_docs, net).collect()) == 8
    assert bytecnn.score_documents(no_docs, net).collect() == []
