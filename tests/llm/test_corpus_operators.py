"""Operators over whole corpora, against brute force."""

import hashlib
import random
import re
from collections import defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowloom.llm import linededup, linking, minhash, queries, secrets, tiles, warc
from rowloom.llm.session import Scratch


def groups(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# linking


@pytest.mark.parametrize("python", [False, True])
def test_components(spark, python):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(30)] + [(100, 200 + i) for i in range(20)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = linking.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), python).collect()
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert {r.node: r.comp for r in got} == groups(nodes, edges)
    assert len(got) == len(nodes)


@pytest.mark.parametrize("alike", [None, "abs(a_size - b_size) <= 2"])
@pytest.mark.parametrize("small", [0, 10**6])
def test_link_equals_all_pairs(spark, monkeypatch, alike, small):
    """Also where no table counts as small and no edges are joined in one task."""
    monkeypatch.setattr(linking, "SMALL_ROWS", small)
    monkeypatch.setattr(linking, "TASK_EDGES", small)
    rng = random.Random(2)
    members = {(b, rng.randrange(60)) for b in range(25) for _ in range(rng.choice([1, 2, 3, 12]))}
    linked = {p for p in combinations(range(60), 2) if rng.random() < 0.25}
    table = spark.createDataFrame(sorted(linked), "a long, b long")
    shared = {p for b in range(25) for p in combinations(sorted(n for x, n in members if x == b), 2)}
    scratch = Scratch(spark, "t")
    rows = scratch.keep(linking.distinct_buckets(spark.createDataFrame([(*m, rng.randrange(5), m[1] % 7) for m in sorted(members)], "bucket long, node long, weight long, size long")))
    if alike:
        linked = {(a, b) for a, b in linked if abs(a % 7 - b % 7) <= 2}
    got = linking.link(rows, lambda pairs: pairs.join(table, ["a", "b"], "left_semi"), scratch, alike or "true")[0].collect()
    want = groups(range(60), shared & linked)
    assert {n: {r.node: r.comp for r in got}.get(n, n) for n in range(60)} == want


# near-duplicates


def shingles(text, n):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("n", "limit", "tile"), [(2, 10**6, 512), (5, 10**6, 512), (2, 0, 3)])
def test_near_duplicates(make_docs, monkeypatch, n, limit, tile):
    """Also where nothing is small enough to be broadcast or joined in one task, and tiles are small."""
    for module, name in ((minhash, "SENT_NODES"), (linking, "SMALL_ROWS"), (linking, "TASK_EDGES")):
        monkeypatch.setattr(module, name, limit)
    monkeypatch.setattr(tiles, "TILE", tile)
    rng = random.Random(n)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 3, 20, 120]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(50)}"
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    texts += [None, "", "  ", "one", "ONE", "one two"]
    sets = [shingles(t, n) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = groups(range(len(texts)), links)
    got = {r.doc_id: r for r in minhash.near_duplicates(make_docs(texts), shingle=n).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())
    assert {r.doc_id for r in minhash.drop_near_duplicates(make_docs(texts), shingle=n).collect()} == {i for i in want if want[i] == i}


def test_near_duplicates_hard(hard_docs, no_docs):
    got = minhash.near_duplicates(hard_docs).collect()
    assert len(got) == 8 and all(r.kept for r in got)
    kept = minhash.drop_near_duplicates(hard_docs)
    assert kept.columns == hard_docs.columns and kept.count() == 8
    assert minhash.near_duplicates(no_docs).collect() == []


def test_tensored_keys_find_links():
    """The share of 0.8-similar pairs without a common key stays under one in a thousand, by the formula and as measured."""
    s, missed = 0.8, 1.0
    one = 1 - (1 - s**minhash.ROWS) ** minhash.REPEATS
    missed = 1 - one * one
    assert missed < 1e-3
    rng = np.random.default_rng(3)
    pairs = 300
    found = 0
    for _ in range(pairs):
        both = rng.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2)
        a, b = (minhash.half_hashes(np.unique(x)) for x in (both[:360], both[40:]))  # 320 of 400
        found += bool((a == b)[: minhash.REPEATS].any() and (a == b)[minhash.REPEATS :].any())
    assert found >= 0.99 * pairs


def test_sketch_bound():
    """Slots that differ are never more than elements that differ, also between sketches of different sizes."""
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (10, 14), (60, 70), (500, 520), (500, 600), (1000, 1030)):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[: n * 9 // 10], rng.integers(0, 1 << 63, m - n * 9 // 10).astype(np.uint64))))
        x, y = (np.frombuffer(tiles.sketch_of(s), np.uint64) for s in (a, b))
        words = min(len(x), len(y))
        assert int(np.bitwise_count(tiles.fold(x, words) ^ tiles.fold(y, words)).sum()) <= len(np.setxor1d(a, b))


# fuzzy lines


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_near(a, b):
    """The rule of the docstring, on normalised lines."""
    longest = max(len(a), len(b))
    if abs(len(a) - len(b)) > int(longest * 0.2 + 1e-9):
        return False
    if longest <= 250:
        return edit_distance(a, b) <= int(longest * 0.2 + 1e-9)
    a, b = a.split(), b.split()
    if max(len(a), len(b)) <= 1000:
        return edit_distance(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9)
    return 2 * len(set(a) & set(b)) >= 0.8 * (len(set(a)) + len(set(b)))


def plain_normal(line):
    return re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", line.lower()).strip(" ")


@pytest.mark.parametrize("limit", [10**6, 0])
def test_fuzzy_lines(spark, make_docs, tmp_path, monkeypatch, limit):
    """The query against brute force on the similarity alone; also where nothing is small enough to be broadcast."""
    monkeypatch.setattr(linededup, "SENT_NODES", limit)
    monkeypatch.setattr(linking, "SMALL_ROWS", limit)
    rng = random.Random(18)
    lines = []
    for n in (1, 2, 3, 5, 8, 10, 12, 20, 50, 100, 1100) * (3 if limit else 1):
        base = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(3, 9))) for _ in range(n)]
        lines.append(" ".join(base))
        for changes in (1, max(1, n // 12)):
            copy = list(base)
            for at in rng.sample(range(n), changes):
                copy[at] = copy[at] + "x" if n < 5 else "changed"
            lines.append(rng.choice(["", "- "]) + " ".join(copy).capitalize() + rng.choice([".", "!", ""]))
        lines.append(" ".join(base[:-1] if n > 5 else base) + "y")
    lines += ["漢字仮名交文章例文続行本日晴天" + x for x in ("甲", "乙")]
    forms = [plain_normal(x) for x in lines]
    want = groups(forms, [(a, b) for a, b in combinations(forms, 2) if plain_near(a, b)])
    texts = ["\n".join(lines[i : i + 3]) for i in range(0, len(lines), 3)] + ["---\n\n" + lines[0], None, "", "\n\n"]
    make_docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op6_fuzzy_lines(spark, str(tmp_path))
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
    got = {r.doc_id: r for r in out.collect()}
    seen, missed = set(), 0
    for i, t in enumerate(texts):
        keep = []
        for x in (t or "").split("\n"):
            c = want.get(plain_normal(x))
            if c is None or c not in seen:
                keep.append(x)
            seen.add(c)
        missed += (got[i].text or "") != "\n".join(keep)
        assert got[i].n_lines == (0 if t is None else len(t.split("\n")))
    assert missed == 0
    assert got[len(texts) - 3].text is None and got[len(texts) - 2].text == "" and got[len(texts) - 1].text == "\n\n"


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_fuzzy_lines_recall(spark, sf):
    """Of all pairs of distinct lines of edit similarity 0.8, in characters, nine in ten or more are in one group."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    lines = sorted({plain_normal(x) for r in docs.select("text").collect() for x in (r.text or "").split("\n")} - {""}, key=len)
    size = np.array([len(x) for x in lines])
    letters = np.zeros((len(lines), 64), np.int32)
    for i, x in enumerate(lines):
        letters[i] = np.bincount(np.frombuffer(x.encode("utf-32-le"), np.uint32) % 64, minlength=64)
    pairs = []
    for i in range(len(lines)):
        to = np.searchsorted(size, size[i] * 1.25 + 1e-9, "right")
        other = letters[i + 1 : to] - letters[i]
        # Letters too many on either side: a bound of the edit distance.
        may = np.maximum(np.maximum(other, 0).sum(1), np.maximum(-other, 0).sum(1)) <= np.floor(0.2 * size[i + 1 : to] + 1e-9)
        pairs += [(lines[i], lines[i + 1 + j]) for j in np.flatnonzero(may)]
    table = spark.createDataFrame(pa.table({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}).to_pandas()).repartition(16)
    near = table.where("levenshtein(a, b, CAST(floor(0.2D * greatest(length(a), length(b)) + 1e-9D) AS INT)) >= 0").select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")).collect()
    labels = {r.node: r.comp for r in linededup.group_lines(docs.select("doc_id", "text"), Scratch(spark, "t"))[1].collect()}
    assert near and sum(labels.get(r.a, r.a) == labels.get(r.b, r.b) for r in near) >= 0.9 * len(near)


def test_simhash(spark):
    """Both forms against a plain majority of the bits of the words' hashes; near lines share a key of it, others don't."""
    rng = random.Random(7)
    lines = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n)) for n in (1, 2, 3, 8, 30, 200)]
    lines += [lines[4].replace(lines[4].split()[9], "changed"), "文" * 10 + "字" * 9, "twice the same twice"]
    table = spark.createDataFrame([(x, i) for i, x in enumerate([*lines, lines[4], lines[4]])], "line string, spot long").select("line", F.length("line").alias("size"), "spot", F.xxhash64("line").alias("node"))
    words = {x: {x[i : i + 3] for i in range(len(x) - 2)} if x[0] == "文" else set(x.split()) for x in lines}
    of = spark.createDataFrame([(w,) for w in set().union(*words.values())], "w string").select("w", F.xxhash64("w").alias("h"), F.xxhash64(F.lit(2), "w").alias("g")).collect()
    name = {r.node: r.line for r in table.collect()}
    want = {}
    for x, u in words.items():
        for k in "hg":
            hashes = [r[k] for r in of if r.w in u]
            sim = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
            want[x, k] = sim - (1 << 64 if sim >> 63 else 0)
    for form in (linededup.simhashes, linededup.simhashes_of_long):
        rows = form(table).collect()
        assert len(rows) == len(lines)
        for r in rows:
            x = name[r.node]
            assert (r.sim, r.sim2) == (want[x, "h"], want[x, "g"])
            assert (r.units, r.weight, r.size) == (len(words[x]), 3 if x == lines[4] else 1, len(x))
    nodes = linededup.simhashes(table)
    shared = linededup.near_buckets(nodes, 16)
    met = linededup.sim_keys(nodes, 16).join(shared, "bucket").select("node").distinct().collect()
    assert {name[r.node] for r in met} == {lines[4], lines[6]}


def test_simhash_keys_of_large_tables(spark):
    """With keys as long as 28 million lines need (6 GB), a line has few of them, and near lines still share one."""
    bits = linededup.key_bits(28_000_000)
    assert linededup.n_tables(bits) <= 40
    rng = random.Random(25)
    lines = []
    for _ in range(200):
        base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(30)]
        lines += [" ".join(base), " ".join("changed" if i in (4, 17) else w for i, w in enumerate(base))]
    table = spark.createDataFrame([(x, i, i // 2) for i, x in enumerate(lines)], "line string, spot long, pair long").select("line", F.length("line").alias("size"), "spot", F.xxhash64("line").alias("node"), "pair")
    keys = linededup.sim_keys(linededup.simhashes(table), bits).join(table.select("node", "pair"), "node")
    met = keys.groupBy("bucket").agg(F.count_distinct("node").alias("n"), F.count_distinct("pair").alias("pairs"), F.min("pair").alias("pair")).where("n > 1").collect()
    assert all(r.pairs == 1 for r in met) and len({r.pair for r in met}) >= 190


def test_simhash_narrow(spark):
    """Lanes of 8 bits give the SimHashes of lanes of 16, up to the most units that they hold."""
    lines = [" ".join(f"w{n}x{i}" for i in range(n)) for n in (1, 2, 3, 64, 126, linededup.NARROW_LANE)] + ["same " * 126 + "same"]
    table = spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "line string, spot long").select("line", F.length("line").alias("size"), "spot", F.xxhash64("line").alias("node"))
    got, want = (sorted(linededup.simhashes(table, *lane).collect()) for lane in ((linededup.NARROW_LANE,), ()))
    assert got == want and len(got) == len(lines)


def test_fuzzy_lines_frees_tables(spark, make_docs):
    """When lines are linked, no text and no bucket is left on disk."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("lines-*"))
    base = " ".join(f"word{i}" for i in range(30))
    docs = make_docs([base.replace(f"word{i} ", "other ") + f"\nshort line {i}" for i in range(1, 15)])
    assert sum(r.n_lines - r.n_kept_lines for r in linededup.dedup_lines(docs).collect()) >= 13
    (root,) = set(shared.glob("lines-*")) - before
    columns = set().union(*(spark.read.parquet(f"file://{t}").columns for t in root.glob("t*")))
    assert "line_no" in columns and not columns & {"line", "form", "size", "bucket", "rep"}


def test_fuzzy_lines_large_group(spark, make_docs, monkeypatch):
    """What the first choices of bits have joined is not read again for the others: rows of large buckets follow a pass of choices, not all."""
    given = []
    monkeypatch.setattr(linededup, "EARLY_ROWS", 0, raising=False)
    monkeypatch.setattr(linededup, "link", lambda members, *a, **k: given.append(members.count()) or linking.link(members, *a, **k))
    base = [f"word{i}" for i in range(40)]
    lines = [" ".join(base[:i] + ["other"] + base[i + 1 :]) for i in range(40)]
    labels = linededup.group_lines(make_docs(lines), Scratch(spark, "t"))[1].collect()
    assert len(labels) == 40 and len({r.comp for r in labels}) == 1
    assert 0 < sum(given) <= linededup.PASS * 40


def test_fuzzy_lines_hard(hard_docs, no_docs):
    got = linededup.dedup_lines(hard_docs)
    assert set(hard_docs.columns) <= set(got.columns)
    rows = got.collect()
    assert len(rows) == 8 and sum(r.text == "twice the same row" for r in rows) == 2
    assert linededup.dedup_lines(no_docs).collect() == []


# secrets


def plain_spans(text):
    found = []
    assign = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for k, (name, pattern) in enumerate((("assign", assign), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+")))):
        for m in pattern.finditer(text or ""):
            if (len(m[2]) >= 12) if name == "assign" else len(m[0]) >= (18, 16)[k - 1]:
                found.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(found)]


def test_secrets(make_docs):
    rng = random.Random(9)
    parts = ["é🙂 ", "token = '0123456789abcdef01'", "API-KEY: short", "api_key=ABCdef123456", "AKIA" + "A1" * 8, "AKIA12 ", "deadbeef" * 3, "secret: token=abcdef", "passwd\":\"x/y+z=._-12345", "\n", "PASSWORD==aaaaaaaaaaaa", "toKen=abcdefghijkl ", "aB3" * 9]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(12))), f"s{i % 3}") for i in range(60)] + [(1, None, "s1"), (70, "Zz9" + "q8W7e6R5t4Y3u2I1" * 2, "only")]
    got = secrets.scan_secrets(make_docs(docs)).collect()
    want = defaultdict(list)
    for i, t, _ in docs:
        want[i].append(plain_spans(t))
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("opaque")]
        assert base in want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
    assert len(got) == len(docs)
    # A value of one owner is added, one of three owners is a copied example.
    alone = next(r for r in got if r.doc_id == 70)
    assert alone.spans == "opaque:0:35" and alone.n_live == 1
    assert any(r.n_copied for r in got)


def test_secrets_by_owners_and_repositories(spark):
    """Either count alone makes a value a copied example; copies in one repository, or with a second owner, don't."""
    token = "Zz9q8W7e6R5t4Y3u2I1kLmN0p"
    cases = {"repeated": [("o", "r")] * 9, "two owners": [("o", "r"), ("p", "r")], "owners": [("o", "r"), ("p", "r"), (None, "r")], "repos": [("o", "r"), ("o", "s"), ("o", "t"), ("o", None)]}
    rows = [(i, token + chr(65 + i), owner, repo) for i, places in enumerate(cases.values()) for owner, repo in places]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for r in secrets.scan_secrets(docs).collect():
        copied = list(cases)[r.doc_id] in ("owners", "repos")
        assert (r.n_copied, r.n_live, r.spans) == ((0, 0, "") if copied else (0, 1, "opaque:0:26"))
    named = spark.createDataFrame([(r[0], "token=" + r[1], *r[2:]) for r in rows], docs.schema)
    assert {r.doc_id: (r.n_assign, r.n_copied > 0) for r in secrets.scan_secrets(named).collect()} == {0: (1, False), 1: (1, False), 2: (1, True), 3: (1, True)}


def test_secrets_hard(hard_docs, no_docs):
    got = secrets.scan_secrets(hard_docs).collect()
    assert len(got) == 8 and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert secrets.scan_secrets(no_docs).collect() == []


def test_native_plans(make_docs):
    """No Python in the plans of the native operators."""
    docs = make_docs(["token = 0123456789abcdef01\nfirst line of the text", "first line of the text"])
    for out in (secrets.scan_secrets(docs), linededup.dedup_lines(docs)):
        assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())


# archives


def test_archives(spark, tmp_path):
    rng = random.Random(10)
    urls = [f"http://{h}.example.com/{p}?q={q}" for h in ("a", "b", "WWW.c") for p in ("", "x", "y") for q in range(3)] + [None, "", "no url", "http://[bad", "http://a.example.com/é \r\nX: 1"]
    rows = [(i, rng.choice(urls), rng.choice(["", None, "<p>é</p>", "same\r\n\r\npage", f"own {i}"])) for i in range(300)] + [(None, "http://a.example.com/", "own 5"), (None, None, "null id alone"), (7, "http://b.example.com/x?q=1", "again")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    root = f"file://{tmp_path}/w"
    got = warc.archive_round_trip(spark, pages, uri=root).collect()
    largest = {}
    for i, _, html in rows:
        h = html or ""
        largest[h] = max((x for x in (largest.get(h), i) if x is not None), default=None)

    def want(i, html):
        h = html or ""
        top = largest[h]
        revisit = top is not None and i != top
        return (i, len(h.encode()), warc.digest32(h.encode()), "revisit" if revisit else "response", top if revisit else None)

    assert sorted(map(repr, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(repr(want(i, h)) for i, _, h in rows)


def test_index_look_up(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example.org/p{i % 50}", f"page {i}") for i in range(2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    scratch, root = Scratch(spark, "t"), f"file://{tmp_path}/w"
    index = warc.build_index(warc.write_archives(pages, f"{root}/a", scratch), f"{root}/i", f"{root}/a", block_lines=20)
    reader = warc.Reader(index)
    for url in {u for _, u, _ in rows[:200]}:
        found = sorted(reader.record(c)[0] for c in reader.captures(warc.url_key(url), any_id=True))
        assert found == [i for i, u, _ in rows if u == url]
    assert list(reader.captures("zz,nowhere)/", any_id=True)) == []
    assert [reader.record(c)[0] for c in reader.captures(warc.url_key(rows[5][1]), 5)] == [5]


def test_archives_hard(spark, tmp_path):
    """Extra columns with names that the operator uses, and a very long payload."""
    html = "<p>é漢</p>" * 300_000
    pages = spark.createDataFrame([(1, "http://a/", html), (2, "http://a/", html), (3, None, None)], "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("digest", "n_bytes", "chosen", "n", "revisit", "refers_to", "file", "offset", "length", "url_key")})
    got = {r.page_id: r for r in warc.archive_round_trip(spark, pages, uri=f"file://{tmp_path}/w").collect()}
    assert {i: (r.payload_bytes, r.record_type, r.refers_to) for i, r in got.items()} == {1: (len(html.encode()), "revisit", 2), 2: (len(html.encode()), "response", None), 3: (0, "response", None)}


def test_archives_threshold_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.archive_round_trip(spark, pages, least_bytes=3, uri=f"file://{tmp_path}/x").collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.archive_round_trip(spark, pages.limit(0), uri=f"file://{tmp_path}/y").collect() == []


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "line dedup", "minhash near-dedup", "benchmark decontamination", "byte-level bpe"]
    scratch = Scratch(spark, "t")
    for i, (_, stage) in enumerate(cp.STAGES):
        out = scratch.keep(stage(spark, docs, sf))
        if i < 4:
            assert out.schema.simpleString() == docs.schema.simpleString()
        if i == 1:
            assert out.count() == docs.count()
        if i == 2:
            rows = docs.select("doc_id", "text").collect()
            sets = {r.doc_id: shingles(r.text, 5) for r in rows}
            links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            want = groups(sets, links)
            assert {r.doc_id for r in out.collect()} == {i for i in want if want[i] == i}
        if i == 4:
            assert out.count() == docs.count() and out.where("NOT round_trip").isEmpty()
        docs = out


def test_pipeline_hard(spark, hard_docs, no_docs):
    """Null and empty texts, a null id, repeated rows and clashing columns pass each stage; no rows give none."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    scratch = Scratch(spark, "t")
    for i, (_, stage) in enumerate(cp.STAGES):
        out = scratch.keep(stage(spark, hard_docs, sf))
        assert scratch.keep(stage(spark, no_docs, sf)).count() == 0
        rows = out.collect()
        # What repeats is one document; of the texts without words all stay.
        assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "5", "5", "6", "7", "None"]
        if i < 4:
            assert out.columns == hard_docs.columns and all(r.kept == r.comp == r["_doc"] == "x" for r in rows)
            assert next(r.text for r in rows if r.doc_id == 1) is None and next(r.text for r in rows if r.doc_id == 2) == ""
        else:
            assert {r.doc_id: r.n_tokens for r in rows}[1] == 0 and all(r.round_trip for r in rows)


def test_pipeline_run(spark, make_docs, tmp_path):
    """From documents to tokens: a toxic one, an exact and a near copy, a benchmark passage go; the clean ones stay."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    rng = random.Random(5)
    clean = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)) for _ in range(4)]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("size(split(text, ' ')) >= 12").first().text
    make_docs([*clean, clean[1], clean[2] + " end", clean[3][:200] + "\n" + item]).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0 if name == "labels" else 10**6).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.doc_id: r.n_tokens for r in cp.run(spark, str(tmp_path)).collect()}
    assert {i for i, n in got.items() if n} == {0, 1, 2, 3} and 6 not in got
