"""Corpus operators against brute force, exact round trips and held-out accuracy, on small tables."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from kinetrace.llm import bpe, embeddings, fingerprints, jaccard, language, lines, packing, shards, toxicity, warc
from kinetrace.llm.common import components, excerpt, new_path, numbered

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "   ", "\n\n", "ÄÖ ß 日本\x85語", "one two three", "a" * 5000, "🙂 " * 300, "same text of some words here", "same text of some words here"]
WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rt", "ll", "st")]


def rows_of(texts, first=0):
    return [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


def clash(df):
    """Extra columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("own") for c in ("n_lines", "score", "lang_pred", "predicted", "ambiguous", "h1", "key", "k", "drop", "kept_text", "c", "comp", "shard", "size", "pos", "line")})


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies (one hot group of each), short and odd texts, shuffled ids, a repeated row."""
    rng = random.Random(7)
    texts = [sentence(rng, rng.choice([1, 3, 5, 6, 9, 20, 60, 150])) for _ in range(60)]
    base = sentence(rng, 80).split()
    for i in range(40):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"new{i}x{rng.randrange(99)}"
        texts.append(" ".join(w))
    passage = sentence(rng, 30)
    texts += [f"{sentence(rng, 10)} {passage} {sentence(rng, 5)}" for _ in range(25)] + [texts[0]] * 15 + [texts[70]] * 5 + ODD
    texts += [texts[5].upper(), "A b  C\td\ne", "a B c d\x0be"]
    rng.shuffle(texts)
    rows = rows_of(texts, 100)
    return rows + [rows[3]]


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_join(spark, corpus, monkeypatch):
    want = brute_components(corpus)
    df = clash(spark.createDataFrame(corpus, DOCS))
    # Light and heavy sides, and the exact pairing of open lists without any hub rounds.
    for boundary, hubs in ((None, None), (1000, None), (0, None), (None, (1,))):
        with monkeypatch.context() as m:
            if boundary is not None:
                m.setattr(jaccard, "BOUNDARIES", (boundary,))
            if hubs:
                m.setattr(jaccard, "HUBS", hubs)
                m.setattr(jaccard, "ROUNDS", len(hubs))
            got = jaccard.join_documents(df).collect()
        assert len(got) == len(corpus) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    empty = spark.createDataFrame([], DOCS)
    assert jaccard.join_documents(empty).count() == 0
    nameless = spark.createDataFrame([(None, "a b c d e f", None, None, None), (5, "a b c d e f", None, None, None)], DOCS)
    assert [r.component_id for r in jaccard.join_documents(nameless).collect()] == [5, 5]


def test_pruned_lists_keep_all_that_may_link():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(3, 40))
        s = np.sort(rng.integers(0, 1 << 60, n).astype(np.uint64))
        change = int(rng.integers(0, n // 4 + 1))
        t = np.sort(np.concatenate([s[change:], rng.integers(0, 1 << 60, int(rng.integers(0, change + 1))).astype(np.uint64)]))
        common = len(np.intersect1d(s, t))
        if len(t) < 3 or 100 * common < 75 * (len(s) + len(t) - common):
            continue
        counts = rng.integers(0, 9, 1 << 10).astype(np.uint8)
        for boundary in (0, 16, 1000):
            (k1, r1), (k2, r2) = jaccard.keys_of(s, counts, boundary), jaccard.keys_of(t, counts, boundary)
            both, i, j = np.intersect1d(k1, k2, return_indices=True)
            assert len(both) and jaccard.may_link(len(s), len(t), r1[i], r2[j]).any()


def test_images_keep_all_that_may_link(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
    sets = []
    for n in (3, 40, 900, 9000, 30000):  # the last two are crowded
        base = draw(n)
        sets += [np.unique(np.concatenate([base[: n - cut], draw(cut)])) for cut in (0, n // 8, n // 7, n // 3)] + [np.unique(draw(n))]
    bits = [np.unpackbits(np.frombuffer(jaccard.image(s), np.uint8)).astype(bool) for s in sets]
    table = spark.createDataFrame([(i, len(s), int(b.sum()), jaccard.image(s)) for i, (s, b) in enumerate(zip(sets, bits))], "c long, n int, p int, image binary")
    pairs = spark.createDataFrame([(i, j) for i in range(len(sets)) for j in range(i)], "a long, b long")
    kept = {(r.a, r.b) for r in jaccard.bounded(pairs, table, True).collect()}
    assert kept == {(r.a, r.b) for r in jaccard.bounded(pairs, table).collect()}
    distance = lambda i, j: 1 - (bits[i] & bits[j]).sum() / (bits[i] | bits[j]).sum()
    links = 0
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                links += 1
                load = max(len(sets[x]) / bits[x].sum() for x in (i, j))
                assert (i, j) in kept and distance(i, j) <= jaccard.LINK * load
    assert links >= 8
    assert not any((i, j) in kept for i in range(5, 15) for j in range(5, i) if (i % 5 == 4 or j % 5 == 4))  # strangers
    assert jaccard.imaged(pairs, table).where(F.col("both") > F.least("p", "q")).count() == 0


def test_strangers_in_a_list_are_not_dealt_out_whole(spark, monkeypatch):
    """Many texts that share a passage, three of them near copies: whole sets only of these."""
    rng = random.Random(3)
    passage = sentence(rng, 30)
    texts = [f"{sentence(rng, 60)} {passage}" for _ in range(40)]
    texts += [f"{texts[0]} end", f"{texts[0]} stop"]
    dealt = []
    own = jaccard.dealt_by_class
    monkeypatch.setattr(jaccard, "dealt_by_class", lambda rows, name: dealt.append((name, (out := own(rows, name)).count())) or out)
    monkeypatch.setattr(jaccard, "choose_boundary", lambda *a: 0)
    monkeypatch.setattr(jaccard, "keys_of", lambda s, counts, boundary: (jaccard.mixed(s) | np.uint64(1), np.full(len(s), len(s))))  # lists of the passage too
    rows = rows_of(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_components(rows)
    assert dict(dealt[:1]) == {"images": 42} and all(n <= 10 for name, n in dealt if name == "sets")


def test_exchanges_of_stored_tables_are_deleted(spark):
    import time

    from kinetrace.llm.common import stash, stash_by

    def files():
        found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = files()
    for k, put in enumerate((lambda d: stash(d, "exchanged"), lambda d: stash_by(d, "id", "exchanged"))):
        put(spark.range(2000 + k).repartition(5, "id"))
        until = time.time() + 20
        while time.time() < until and any(x.endswith(".data") for x in files() - before):
            time.sleep(0.2)
        assert not [x for x in files() - before if x.endswith(".data")], k


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)

    def find(a):
        return a if root[a] == a else find(root[a])

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert all(got.get(i, i) == find(i) for i in root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(spark, corpus):
    rng = random.Random(2)
    shared = ["A line that many have", "short", " a LINE that many have\t", "x" * 9, "y" * 10]
    texts = ["\n".join(rng.choice([*shared, sentence(rng, 4)]) for _ in range(rng.randrange(1, 8))) for _ in range(40)] + ODD
    rows = rows_of(texts)
    strip = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")
    key = lambda x: strip.sub("", x).translate({c: c + 32 for c in range(65, 91)})
    holders = collections.defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    for least in (2, 3):
        gone = {k for k, h in holders.items() if len(k) >= 10 and len(h) >= least}
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in lines.dedup_lines(clash(spark.createDataFrame(rows, DOCS)), min_docs=least).collect()}
        for i, t, *_ in rows:
            own = (t or "").split("\n")
            kept = [x for x in own if not (key(x) in gone and i > min(holders[key(x)]))]
            assert got[i] == (len(own), len(own) - len(kept), "\n".join(kept))
    assert lines.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def best_capacity(sizes, shards):
    """The least capacity by trying all contiguous cuts (dynamic programming)."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    best = [0] + [10**18] * len(sizes)
    for _ in range(shards):
        best = [min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(ends))]
    return best[-1]


@pytest.mark.parametrize("hot", [0, 200])
def test_sharding(spark, hot, monkeypatch):
    rng = random.Random(hot)
    texts = ["x" * rng.randrange(0, 400) + str(i) for i in range(150)] + ["the hot text of all"] * hot + ODD
    df = clash(spark.createDataFrame(rows_of(texts), DOCS)).drop("shard", "size", "k")
    monkeypatch.setattr(shards, "FIRST_BITS", 2)
    monkeypatch.setattr(shards, "MORE_BITS", 3)
    got = shards.shard_documents(df, 6).collect()
    text = dict(enumerate(texts))
    assert len(got) == len(texts) and all(r.size == len((text[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got)
    by = collections.defaultdict(list)
    where = collections.defaultdict(set)
    for r in got:
        by[r.shard].append(r)
        where[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values()) and all(sorted(r.slot for r in g) == list(range(len(g))) for g in by.values())
    keys = {r.k: r.bytes for r in df.selectExpr("xxhash64(coalesce(text, '')) k", "coalesce(octet_length(text), 0) + 8 b").groupBy("k").agg({"b": "sum"}).withColumnRenamed("sum(b)", "bytes").collect()}
    assert max(sum(r.size for r in g) for g in by.values()) == best_capacity([keys[k] for k in sorted(keys)], 6)
    assert shards.shard_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_numbered(spark):
    df = spark.createDataFrame([(i % 3, i // 2) for i in range(3000)], "g int, x long").cache()
    by = collections.defaultdict(list)
    for r in numbered(df, ["g"], ["x"], 3000, "slot").collect():
        by[r.g].append(r.slot)
    assert all(sorted(v) == list(range(1000)) for v in by.values())


ALPHABET = "ab cdéÑß'sllt \n\t  12345.,!?  \x1c\x85 日本語👍🏽é\x00|>ABCΣςİſ"


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 60))) for _ in range(n)] + ["x<|endoftext|>y<|startoftext|>", "a" * 1500, "é" * 700 + " " + "ab" * 900, "they'll WE'RE 'd", "", "  "]


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path("byte_bpe_50k.json")
    t, own, texts = Tokenizer.from_file(path), bpe.Bpe(path), odd_texts(1500)
    got = own.encode_batch(texts)
    for x, e, g in zip(texts, t.encode_batch(texts, add_special_tokens=False), got, strict=True):
        assert np.array(e.ids, "<u4").tobytes() == g and own.decode(g) == x == t.decode(e.ids, skip_special_tokens=False)
    assert own.decode(np.array([255, 160], "<u4").tobytes()) == t.decode([255, 160], skip_special_tokens=False)
    df = clash(spark.createDataFrame(rows_of(ODD), DOCS))
    assert [r.decoded for r in bpe.bpe_documents(df, path).orderBy("doc_id").collect()] == [x or "" for x in ODD]
    assert bpe.digest_documents(df, path).count() == len(ODD) and bpe.digest_documents(spark.createDataFrame([], DOCS), path).count() == 0


def test_bpe_trees_agree():
    own = bpe.Bpe(bpe.tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(3)
    words = ["".join(rng.choice("thesingorand") for _ in range(rng.randrange(2, 120))).encode() for _ in range(300)]
    assert own.merge_all(words) == [own.merge_long(w) for w in words]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("word_bpe_49k.json")
    texts = odd_texts(300, 5) + ODD + [sentence(random.Random(1), 5000)]
    rows = rows_of(texts)
    ids = {i: [*e.ids, 1] for (i, *_), e in zip(rows, Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True)}
    got = packing.pack_documents(clash(spark.createDataFrame(rows, DOCS).repartition(3)), path, with_ids=True).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    for length, last in collections.Counter(r.length for r in got).items():
        own = sorted(r.sequence_id for r in got if r.length == length)
        assert own == list(range(own[0], own[0] + last))
    seen = collections.defaultdict(list)
    for r in got:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and r.doc_tokens == len(ids[r.doc_id])
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert bytes(r.ids) == own and zlib.crc32(own) == r.ids_crc32
        seen[r.doc_id].append((r.start, r.length))
    for i, p in seen.items():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and sum(n for _, n in p) == len(ids[i])
    assert packing.pack_documents(spark.createDataFrame([], DOCS), path).count() == 0


def test_fingerprints(spark):
    rng = random.Random(4)
    texts = [sentence(rng, rng.choice([2, 8, 40, 200])) for _ in range(60)] + ODD
    ids = rng.sample(range(1000), len(texts))
    rows = [(i, t, None, None, None) for i, t in zip(ids, texts, strict=True)]
    df = clash(spark.createDataFrame(rows + rows[:1], DOCS))
    got = fingerprints.fingerprint_documents(df).collect()
    assert len(got) == len(rows) + 1 and sum(r.doc_id == rows[0][0] for r in got) == 2
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    by = {r.doc_id: r for r in got}
    prints = collections.defaultdict(set)
    for (i, t, *_), (_, n, *_) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = by[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints[t].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.near_next == 1.0 if t == n else True
    assert all(len(p) == 1 for p in prints.values())
    long = [r for r in got if r.n_chars > 600]
    assert np.mean([r.near_edited for r in long]) > 0.2 > np.mean([r.near_next for r in long])
    assert fingerprints.fingerprint_documents(spark.createDataFrame([], DOCS)).count() == 0
    one = fingerprints.fingerprint_documents(spark.createDataFrame(rows_of(["a b c d e f g h"]), DOCS)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_sketches_estimate_containment(spark):
    from pyspark.sql import functions as F

    w = [f"w{i}" for i in range(4000)]
    df = spark.createDataFrame([(" ".join(w[:400]), " ".join(w))], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = df.select(fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.likeness(F.col("a"), F.col("b")).alias("j")).first()
    assert r.c == 1.0 and abs(r.j - 396 / 3996) < 0.05


PAGES = "page_id long, url string, html string"


def test_warc(spark):
    html = ["<p>same</p>"] * 30 + [None, "", "é€🙂" * 50, "<p>only</p>"]
    rows = [(i, f"http://x/{i}\n ", h) for i, h in enumerate(html)] + [(29, "u", "<p>same</p>"), (None, "v", "<p>same</p>")]
    files = warc.write_pages(clash(spark.createDataFrame(rows, PAGES)), new_path(spark, "warc"))
    got = warc.read_archives(files).where("kind = 'record'").collect()
    assert len(got) == len(rows) and warc.read_archives(files).where("kind = 'gap'").count() == 0
    for r in got:
        m = re.fullmatch(r"<urn:page:(\d*)>", r.headers["WARC-Record-ID"])
        payload = (html[int(m[1])] or "").encode() if m[1] else b"<p>same</p>"
        last = 29 if payload == b"<p>same</p>" else 31 if not payload else int(m[1])
        assert r.headers["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r.headers["WARC-Type"] == ("response" if m[1] and int(m[1]) == last else "revisit")
        assert bytes(r.payload) == (payload if r.headers["WARC-Type"] == "response" else b"")
    assert warc.write_pages(spark.createDataFrame([], PAGES), new_path(spark, "warc")).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    rng = random.Random(9)
    recs = [warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{i}>"}, rng.randbytes(rng.randrange(0, 200_000))) for i in range(8)]
    parts = [warc.member(r) if packed else r for r in recs]
    offsets = [sum(map(len, parts[:i])) for i in range(9)]

    def read_all(data):
        return list(warc.salvage(lambda at, n: data[at : at + n], len(data)))

    whole = read_all(b"".join(parts))
    assert [(f.offset, f.length, f.reason) for f in whole] == [(offsets[i], len(parts[i]), "") for i in range(8)]
    for _ in range(25):
        data, hit = bytearray(b"".join(parts)), rng.randrange(8)
        at = offsets[hit] + rng.randrange(len(parts[hit]))
        data[at : at + 3] = b"\xff\x00\xff"
        found = read_all(bytes(data))
        assert sum(f.length for f in found) == len(data) and [f.offset for f in found] == [sum(g.length for g in found[:i]) for i in range(len(found))]
        kept = {f.headers["WARC-Record-ID"] for f in found if not f.reason}
        touched = {i for i in range(8) if offsets[i] < at + 3 and at < offsets[i + 1]}
        assert {f"<urn:page:{i}>" for i in range(8) if i not in touched} <= kept
    junk = read_all(b"junk" * 50_000 + parts[0] + b"WARC/1.1 no" + parts[1][:-3])
    assert [bool(f.reason) for f in junk] == [True, False, True]
    assert read_all(b"") == []


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    vectors = [list(map(float, v)) for v in base] + [list(map(float, 3 * base[0]))] * 20
    vectors += [list(map(float, base[1] + 0.05 * rng.standard_normal(16))) for _ in range(60)]
    for c in (0.951, 0.949):
        u = base[2] / np.linalg.norm(base[2])
        o = base[3] - (base[3] @ u) * u
        vectors.append(list(map(float, c * u + np.sqrt(1 - c * c) * o / np.linalg.norm(o))))
    bad = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, 2.0]]
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(vectors) + len(bad)), vectors + bad, strict=True)]
    monkeypatch.setattr(embeddings, "PART", 16)
    got = {r.vec_id: r for r in embeddings.near_duplicates(clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect()}
    good = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows[: len(vectors)]]
    near = {i: {j for j, y in good if j != i and x @ y >= 0.95} for i, x in good}
    comp = {i: i for i, _ in rows}
    for _ in rows:
        comp = {i: min([c, *(comp[j] for j in near.get(i, ()))]) for i, c in comp.items()}
    for i, _ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(near.get(i, ())), comp[i], comp[i] == i)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize(("n", "dim"), [(10**6, 64), (10**7, 64), (10**8, 64), (10**6, 4), (10**5, 200)])
def test_recall_of_large_tables(n, dim):
    rng = np.random.default_rng(11)
    x, y = rng.standard_normal((2, 400, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    planned = embeddings.plan(n, dim)
    a, b = embeddings.filters_of(x, planned), embeddings.filters_of(y, planned)
    assert np.mean([np.isin(p, q).any() for p, q in zip(a, b, strict=True)]) > 0.99


def labelled(n, seed=0):
    rng = random.Random(seed)
    tongue = {"aa": "the and ing tion er of".split(), "bb": "der die ung keit sch lich".split(), "cc": "que ción mente los ado".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(list(tongue))
        text = " ".join("".join(rng.choice(tongue[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60)))
        rows.append((i, text, lang, "s", len(text)))
    return rows


def test_language(spark):
    rows = labelled(400) + [(1000 + i, t, None if i % 2 else "aa", "s", None) for i, t in enumerate(["", None, "12 34 !!", "%%%"])]
    df = clash(spark.createDataFrame(rows, DOCS))
    model = language.fit(language.sample(df))
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows[:400] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.97
    assert all(got[1000 + i].lang_pred == "und" and got[1000 + i].score == 0 for i in range(4)) and all(0 <= r.score <= 1 for r in got.values())
    # A held-out row's label changes nothing.
    flipped = [(*r[:2], "bb", *r[3:]) if zlib.crc32(str(r[0]).encode()) % 4 == 2 else r for r in rows]
    again = language.fit(language.sample(spark.createDataFrame(flipped, DOCS)))
    assert np.array_equal(again.weights, model.weights)
    for few in ([], rows[:1]):
        m = language.fit(language.sample(spark.createDataFrame(few, DOCS)))
        assert m.predict(["abc", None])[0][1] == "und"
    for k in (2, 3, 7, 8, 30):
        code = language.codewords(k)
        assert len({tuple(c) for c in code.tolist()}) == k and (code.min(0) != code.max(0)).all()


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["grobnak", "snivvle", "worbt"]
    rows, labels = [], []
    for i in range(600):
        w = sentence(rng, rng.randrange(5, 120)).split()
        toxic = int(rng.random() < 0.25)
        for _ in range(toxic * (1 + len(w) // 25)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(bad))
        rows.append((i, " ".join(w), "en", "s", None))
        labels.append((i, 1, toxic))
    df, lab = clash(spark.createDataFrame(rows, DOCS)), spark.createDataFrame(labels + labels[:5], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.sample(df, lab))
    got = {r.doc_id: r for r in toxicity.rate(df, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [got[i].predicted == labels[i][2] for i in held]
    assert np.mean(right) > 0.95 and all((r.score >= 0.7) == (r.predicted == 1) for r in got.values())
    odd = toxicity.rate(spark.createDataFrame(rows_of(ODD), DOCS), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    none = toxicity.fit(toxicity.sample(df, lab.where("toxic = 0")))
    assert none is None and toxicity.rate(df, none).where("score <> 0 OR predicted <> 0").count() == 0


def test_rare_toxic_words():
    """Each in too few training documents to stand out alone, in no other text."""
    rng = random.Random(8)
    bad = ["".join(rng.choice("jqvwxz") + rng.choice("aeiou") for _ in range(4)) for _ in range(200)]

    def made(n):
        for _ in range(n):
            w, toxic = sentence(rng, rng.randrange(20, 60)).split(), int(rng.random() < 0.25)
            for _ in range(5 * toxic):
                w.insert(rng.randrange(len(w) + 1), rng.choice(bad))
            yield " ".join(w), toxic

    model = toxicity.fit(list(made(800)))
    held = list(made(400))
    assert np.mean([model.score(t) >= toxicity.CUT for t, y in held if y]) > 0.9
    assert np.mean([model.score(t) >= toxicity.CUT for t, y in held if not y]) < 0.02


def test_base_of_all_ordinary_texts():
    rng = random.Random(9)
    texts = sorted([f"a {sentence(rng, 30)}" for _ in range(700)] + [f"z {sentence(rng, 15)} quorum vexing zebra {sentence(rng, 15)}" for _ in range(500)])
    base, _ = toxicity.dictionaries([b" jinx "], [toxicity.normal(t) for t in texts])
    assert b"quorum vexing zebra" in base


def test_long_texts_are_learned_from(spark):
    rows = [(i, " ".join([t] * (1 + 25_000 // len(t))) if lang == "cc" else t, lang, s, n) for i, t, lang, s, n in labelled(300)]
    df = spark.createDataFrame(rows, DOCS)
    found = language.sample(df)
    model = language.fit(found)
    assert model.langs == ["aa", "bb", "cc"] and max(len(t) for t, _ in found) <= language.TRAIN_CHARS
    got = {r.doc_id: r.lang_pred for r in language.identify(df, model).collect()}
    assert np.mean([got[i] == lang for i, _, lang, *_ in rows]) > 0.97
    labels = spark.createDataFrame([(r[0], 1, int(r[2] == "cc")) for r in rows], "doc_id long, quality int, toxic int")
    drawn = toxicity.sample(df, labels)
    assert {y for _, y in drawn} == {0, 1} and max(len(t) for t, _ in drawn) <= toxicity.TRAIN_CHARS
    ends = spark.createDataFrame([(0, "".join(map(str, range(9000))))], "doc_id long, text string").select(excerpt("text", 1000)).first()[0]
    assert ends.startswith("0123") and ends.endswith("8999") and len(ends) <= 1000


def test_pipeline(spark, tmp_path, corpus):
    import corpus_pipeline

    rows = labelled(200) + [(2000 + i, *r[1:]) for i, r in enumerate(labelled(30))] + [(3000 + i, t, None, None, None) for i, t in enumerate(["", None, "12 34", "%%%"])]
    rows += [rows[4], (None, "die keit ung sch lich der die keit", "bb", "s", 3)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 50 == 7)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf).write.parquet(f"{sf}/{k}")
        kept.append(spark.read.parquet(f"{sf}/{k}"))
        if k < 4:
            assert kept[-1].schema == docs.schema
    by = [{r.doc_id: r.text for r in d.collect()} for d in kept[:5]]
    assert set(by[0]) - set(by[1]) == {3000, 3001, 3002, 3003}
    want = brute_components([(r.doc_id, r.text) for r in kept[3].where("doc_id IS NOT NULL").collect()])
    assert {i for i in by[4] if i is not None} == {i for i, (_, c) in want.items() if i == c}
    assert kept[4].where("doc_id = 4").count() == 1
    assert {r.doc_id for r in kept[5].collect()} == set(by[4])
    assert corpus_pipeline.run(spark, sf).drop("sequence_id").exceptAll(kept[5].drop("sequence_id")).count() == 0


def test_queries_match_their_sql(spark):
    import os

    import duckdb

    from kinetrace.llm import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        got = queries.QUERIES[name](spark, sf)
        cols = sorted(got.columns)
        want = con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
        assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, want)), name
