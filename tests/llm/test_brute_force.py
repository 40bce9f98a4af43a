"""Operators that SQL cannot express, and odd rows, against plain versions on small tables."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
import zstandard

from kinetrace.llm import embeddings, fingerprints, jaccard, language, lines, packing, toxicity, warc
from kinetrace.llm.bpe import tokenizer_path
from kinetrace.llm.common import discard, key_filter, maybe_held, names_of, new_path, stash

from .test_corpus import DOCS, ODD, PAGES, brute_components, labelled, rows_of, sentence

LOWER = {c: c + 32 for c in range(65, 91)}


# Language.


def plain_language(model, text):
    """One gram at a time; log odds, margins, losses by their formulas."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0, True
    doc = language.normal(text)
    total, n = [0.0] * model.code.shape[1], 0
    for order in language.ORDERS:
        for at in range(len(doc) - order + 1):
            key = 0
            for k in range(order):
                key = (key * 16777619 + doc[at + k] + k + 1) % 2**32
            mixed = key ^ (key >> 15)
            mixed = mixed * 2246822519 % 2**32
            bucket = (mixed ^ (mixed >> 13)) % language.BUCKETS
            n += 1
            for b in range(len(total)):
                total[b] += float(model.weights[bucket, b])
    losses = []
    for word in model.code:
        loss = sum(t * math.log1p(math.exp(-(2 * int(bit) - 1) * (v / n * s + o))) for bit, v, s, o, t in zip(word, total, model.scale, model.shift, model.trust, strict=True))
        losses.append(loss / sum(model.trust))
    best = min(range(len(losses)), key=lambda i: (losses[i], i))
    near = [math.exp(-(x - min(losses)) * model.code.shape[1]) for x in losses]
    gap = sorted(losses)[1] - min(losses) if len(losses) > 1 else math.inf
    return model.langs[best], near[best] / sum(near), gap < language.AMBIGUOUS


def test_language_by_plain_loops(spark):
    rows = labelled(150) + [(1000 + i, t, None, "s", None) for i, t in enumerate([*ODD[:6], "the der que", "é" * 40, "der " * 300])]
    df = spark.createDataFrame(rows + rows[:2], DOCS)
    model = language.fit(language.sample(df))
    got = language.identify(df, model).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        lang, score, unclear = plain_language(model, r.text)
        assert r.lang_pred == lang and math.isclose(r.score, score, rel_tol=1e-3, abs_tol=1e-6) and r.ambiguous == unclear
    assert language.identify(df.limit(0), model).count() == 0


def test_equal_losses_take_the_first_language():
    code = language.codewords(2)
    model = language.Model(["aa", "bb"], code, np.zeros((language.BUCKETS, code.shape[1]), np.float32), np.ones(code.shape[1]), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    assert model.predict(["any text"]) == (["aa"], [0.5], [True])


# Toxicity.


def plain_sum(model, text):
    """Each distinct window by compressors made anew; gains count where a run of the window lies in the toxic dictionary only."""
    p = zstandard.ZstdCompressionParameters(compression_level=3, min_match=5, strategy=zstandard.STRATEGY_BTLAZY2, window_log=21, hash_log=19, chain_log=21, search_log=5, target_length=16, write_content_size=0, write_checksum=0, write_dict_id=0)
    packers = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p) for c in (model.ordinary, model.toxic)]
    doc, seen, total = language.normal(text or ""), set(), 0.0
    at = 0
    while at == 0 or at < len(doc) - 12:
        w = doc[at : at + 24]
        at += 12
        if w in seen:
            continue
        seen.add(w)
        gain = 0
        if any(w[i : i + 6] in model.toxic and w[i : i + 6] not in model.ordinary for i in range(len(w) - 5)):
            a, b = (len(c.compress(w + bytes(48))) for c in packers)
            gain = a - b
        total += model.evidence[max(-2, min(10, gain)) + 2]
    return total


def test_toxicity_by_plain_loops(spark):
    rng = random.Random(5)
    bad = ["grobnak", "snivvle", "worbt"]
    rows = []
    for i in range(240):
        w, toxic = sentence(rng, rng.randrange(4, 50)).split(), int(i % 4 == 0)
        for _ in range(toxic * (1 + len(w) // 15)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(bad))
        rows.append((" ".join(w), toxic))
    model = toxicity.fit(rows)
    texts = [t for t, _ in rows[:40]] + ODD + ["grobnak", " ".join(["snivvle worbt"] * 3000)]
    df = spark.createDataFrame(rows_of(texts + texts[:3]), DOCS)
    for r in toxicity.rate(df, model).collect():
        total = plain_sum(model, r.text)
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, math.log(0.7 / 0.3) + model.slope * (total - model.threshold)))))
        assert math.isclose(r.score, want, rel_tol=1e-6, abs_tol=1e-9) and r.predicted == int(r.score >= 0.7)
    assert toxicity.rate(df.limit(0), model).count() == 0
    # Thresholds keep to their promise on the documents that gave them.
    calm = [t for t, y in rows if not y]
    assert np.mean([model.score(t) >= toxicity.CUT for t in calm]) < 0.05


# Fingerprints.


def murmur_longs(values, seed=42):
    """Spark's hash of long columns: 32-bit Murmur3 of each, seeded with the one before."""
    rot = lambda x, r: (x << r | x >> (32 - r)) & 0xFFFFFFFF
    h = seed
    for v in values:
        h1 = h
        for part in (v & 0xFFFFFFFF, v >> 32 & 0xFFFFFFFF):
            k = rot(part * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
            h1 = (rot(h1 ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
        h1 ^= 8
        h1 = (h1 ^ h1 >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h1 = (h1 ^ h1 >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        h = h1 ^ h1 >> 16
    return h - (1 << 32) if h >> 31 else h


def murmur_array(values, seed=42):
    """Of an array of longs: the same, one element seeding the next."""
    return murmur_longs(values, seed)


def plain_sketch(text):
    words = [w for w in re.split("[ \\t\\n\\x0B\\f\\r]+", text.lower()) if w]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    each = {murmur_longs(h[i : i + 5]) for i in range(len(h) - 4)} if len(h) >= 5 else {murmur_array(h)} if h else set()
    below = {x for x in each if x < -(1 << 31) + (1 << 30)}
    return below or ({min(each)} if each else set())


def plain_text(s):
    return "".join(f"{x + (1 << 31):08X}" for x in sorted(s))


def plain_likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_by_plain_loops(spark):
    rng = random.Random(14)
    texts = [sentence(rng, rng.choice([1, 4, 5, 6, 30, 120])) for _ in range(50)] + ODD + ["word " * 4000]
    rows = [(i, t, None, None, None) for i, t in zip(rng.sample(range(-500, 500), len(texts)), texts, strict=True)]
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, DOCS)).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for (i, t, *_), (_, n, *_) in zip(order, order[1:] + order[:1], strict=True):
        t, n, r = t or "", n or "", got[i]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        own, changed, other = plain_sketch(t), plain_sketch(edited), plain_sketch(n)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == plain_text(own) and r.edited_fingerprint == plain_text(changed)
        assert math.isclose(r.near_edited, plain_likeness(own, changed)) and math.isclose(r.near_next, plain_likeness(own, other))


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(sentence(rng, rng.choice([0, 3, 5, 9, 60])), sentence(rng, rng.choice([0, 3, 5, 9, 60]))) for _ in range(30)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", fingerprints.merge(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))).alias("m"))
    for r in df.collect():
        both = plain_sketch(r.a) | plain_sketch(r.b)
        below = {x for x in both if x < -(1 << 31) + (1 << 30)}
        assert set(r.m) == (below or ({min(both)} if both else set())) and list(r.m) == sorted(r.m)


# Repeated ids.


def plain_groups(rows):
    """Components of documents whose ids may repeat: rows of one id are one document."""
    single = brute_components([(k, t) for k, (_, t) in enumerate(rows)])
    root = {k: c for k, (_, c) in single.items()}
    changed = True
    while changed:
        changed = False
        least = {}
        for k, (i, _) in enumerate(rows):
            if i is not None:
                least[i] = min(least.get(i, root[k]), root[k])
        merge = {root[k]: least[i] for k, (i, _) in enumerate(rows) if i is not None and root[k] != least[i]}
        for k in root:
            if root[k] in merge:
                root[k], changed = merge[root[k]], True
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[root[k]] = min(smallest.get(root[k], i), i)
    return [(i, single[k][0], smallest.get(root[k], i)) for k, (i, _) in enumerate(rows)]


def test_repeated_ids_share_a_component(spark):
    rng = random.Random(21)
    a, b, c = (sentence(rng, 30) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (9, b), (7, c), (7, c), (3, ""), (3, c + " x"), (None, a), (None, sentence(rng, 12)), (None, "")]
    got = jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(key, (tuple(r) for r in got))) == sorted(map(key, plain_groups(rows)))


def plain_kept(rows):
    """The rows that stay: of each component of texts that of the least id (rows without one last), and rows without words; equal rows once."""
    single = brute_components([(k, t) for k, (_, t) in enumerate(rows)])
    groups = collections.defaultdict(list)
    for k, (n, c) in single.items():
        groups[c if n else ("own", k)].append(k)
    firsts = []
    for g in groups.values():
        least = min((rows[k][0] is None, rows[k][0] or 0) for k in g)
        firsts.append([rows[k] for k in g if (rows[k][0] is None, rows[k][0] or 0) == least])
    return firsts


def test_copies_go_whatever_their_ids(spark):
    rng = random.Random(22)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    near = " ".join([*a.split()[:-1], "changed"])
    rows = [(1, a), (5, a), (5, b), (9, b), (7, c), (7, c), (7, near), (3, ""), (3, ""), (4, None), (None, a), (None, sentence(rng, 12)), (None, sentence(rng, 12)), (None, "")]
    df = spark.createDataFrame([(i, t, "own", "own") for i, t in rows], "doc_id long, text string, key0 string, once string")
    got = jaccard.drop_copies(df)
    assert got.columns == df.columns
    found = collections.Counter((r.doc_id, r.text) for r in got.collect())
    assert set(found.values()) == {1} and found.keys() >= {(1, a), (5, b), (7, c), (3, ""), (4, None), (None, "")}
    firsts = plain_kept(rows)
    assert all(sum(k in g for k in found) == 1 for g in firsts) and sum(found.values()) == len({tuple(sorted(set(g), key=str)) for g in firsts})
    assert jaccard.drop_copies(df.limit(0)).count() == 0


def test_lines_of_repeated_ids(spark):
    shared, own = "shared line number one", "unique words of the repeated id"
    rows = [(1, shared), (5, shared), (5, own), (5, f"{own}\n{shared}"), (None, shared), (8, f"x\n{shared}\n{shared}"), (8, f"x\n{shared}\n{shared}")]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, drop0 string, drop_h0 string")
    got = lines.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_dropped", "kept_text"]
    assert sorted((r.doc_id or 0, r.text, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == sorted([(1, shared, 1, 0, shared), (5, shared, 1, 1, ""), (5, own, 1, 0, own), (5, f"{own}\n{shared}", 2, 1, own), (0, shared, 1, 0, shared), *[(8, f"x\n{shared}\n{shared}", 3, 2, "x")] * 2])


def test_repeated_vectors_and_rows_without_id(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v), (1, v), (None, v), (2, [4.0, -3.0, 2.0, -1.0]), (None, None)]
    got = collections.Counter(tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == {(1, 2, 1, True): 2, (None, 2, 1, None): 1, (2, 0, 2, True): 1, (None, 0, None, None): 1}


# Helpers.


def test_names_of_colliding_classes(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (3, 9), (3, 8), (3, 7)], "c1 long, c2 long")
    names = names_of(df, "c1", "c2")
    assert set(names) == {(1, 1), (1, 2), (3, 9), (3, 8), (3, 7)} and len(set(names.values()) | {1, 2, 3}) == 8
    assert names_of(df.where("c1 = 2"), "c1", "c2") == {}


def test_filters_hold_all_their_keys(spark):
    from pyspark.sql import functions as F

    df = spark.range(4000).select(F.xxhash64("id").alias("k"), "id")
    bits = key_filter(df.where("id % 7 = 0").select("k"), 572)
    found = {r.id for r in df.where(maybe_held(bits, F.col("k"))).collect()}
    assert {i for i in range(4000) if i % 7 == 0} <= found and len(found) < 700


def test_stored_tables_are_deleted(spark):
    import os

    df = stash(spark.range(5), "gone")
    path = df._stored[0].removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(path)
    discard(df, None)
    assert not os.path.exists(path)


# WARC.


def test_damage_is_logged_and_not_passed_over(spark, monkeypatch):
    rows = [(i, f"http://x/{i}", f"<p>{'text ' * 50}{i}</p>") for i in range(40)]
    df = spark.createDataFrame(rows, PAGES)
    files = warc.write_pages(df, new_path(spark, "warc"))
    path = files.first()["path"]
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2 : len(data) // 2 + 4] = b"\xff\x00\xff\x00"
    open(path, "wb").write(bytes(data))
    records, gaps = warc.recover(files)
    assert 0 < records.count() < 40 and {r.path for r in gaps.collect()} == {path} and all(r.length > 0 and r.reason for r in gaps.collect())
    monkeypatch.setattr(warc, "table", lambda *_: df)
    assert warc.op5_warc(spark, "").count() == 40
    good = warc.write_pages
    monkeypatch.setattr(warc, "write_pages", lambda *a: files if good else None)
    with pytest.raises(RuntimeError, match="40 records were written"):
        warc.op5_warc(spark, "")


def test_members_beyond_a_cell_are_quarantined(monkeypatch):
    data = warc.member(warc.record({"WARC-Type": "response"}, bytes(1 << 22)))
    monkeypatch.setattr(warc, "MOST_BYTES", 1 << 20)
    found = list(warc.salvage(lambda at, n: data[at : at + n], len(data)))
    assert [f.reason for f in found] == ["member unpacks to more than a cell can hold"] and found[0].length == len(data)


# Pipeline.


def plain_lines(rows):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(LOWER)
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    gone = lambda i, x: len(key(x)) >= 10 and len(holders[key(x)]) >= 2 and i > min(holders[key(x)])
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if not gone(i, x))) for i, t in rows]


def test_pipeline_by_plain_loops(spark, tmp_path):
    """run() against a version of every stage by plain loops, for the same models."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(31)
    rows = []
    for i, t, lang, *_ in labelled(160, 3):
        extra = "\n".join(rng.sample(["this line many documents share", "and another line of some length", "short"], rng.randrange(3)))
        bad = " grobnak snivvle worbt" * (i % 5 == 0)
        rows.append((i, t + bad + ("\n" + extra if extra else ""), lang))
    rows += [(1000 + i, t, None) for i, t in enumerate(["", None, "12 34"])]
    rows += [(2000 + k, rows[k * 7 + 1][1] + " more", rows[k * 7 + 1][2]) for k in range(12)]
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    speech = language.fit(language.sample(docs.select("doc_id", "text", "lang")))
    now = [(i, t) for i, t, _ in rows if (found := plain_language(speech, t))[0] != "und" and not found[2]]
    ids = {i for i, _ in now}
    harm = toxicity.fit(toxicity.sample(docs.where(docs["doc_id"].isin(list(ids))).select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")))
    now = plain_lines([(i, t) for i, t in now if 1 / (1 + math.exp(-harm.slope * (plain_sum(harm, t) - harm.threshold) - math.log(0.7 / 0.3))) < 0.7])
    assert 0 < len(now) < len(ids) < len(rows)
    groups = brute_components(now)
    now = [(i, t) for i, t in now if groups[i][1] == i or not groups[i][0]]
    tokens = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, t in now:
        own = [*tokens.encode(t or "", add_special_tokens=False).ids, 1]
        for start, length in packing.pieces(len(own)):
            piece = struct.pack(f"<{length}I", *own[start : start + length])
            want[i, start, length, zlib.crc32(piece), len(own), piece] += 1
    got = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids)) for r in got) == want
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
