"""The corpus operators on edge cases, against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from conftest import EDGE, WORDS, make, remainder  # noqa: F401
from pyspark.sql import functions as F

from furlong.llm import decontaminate, jaccardjoin, langid, licences, media, packing, pivots, registry, suffixdedup, suffixtree, tokenfile, toxicity

SF = "/root/testdata/sf0.01"


def ids_of(name, text, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


ODD = ["  two  spaces ", "a\nb\n\nc", "   x y", "'s don't we'LL", "é x ́y", "a　b c", "<|endoftext|> x", "tab\tnew\r\nline", "12 345  6", "日本 語\n。"]


ALPHABET = [*"aBé'.,!1 \n\t\r\x0b\x0c\x1c\x85", "\u00a0", "\u3000", "\u2028", "\u200b", "\u0301", "ﬁ", "İ", "ß", "日", "한", "🙂", "'s", "'LL", " the", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "\ufffd", "\0"]


def encodes_like_the_library(name, texts):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from furlong.llm.tokens import encode_column

    whole = Tokenizer.from_file(public_tokenizers.path(name))
    want = [[*e.ids, 0] for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):
        got = [x for a, b, ids, at in encode_column(registry.tokenizer(name), pa.array(texts, pa.string()), 0) for x in np.split(ids, at[1:-1])]
        assert [t for t, x, y in zip(texts, got, want, strict=True) if x.tolist() != y] == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_like_whole_texts(name):
    encodes_like_the_library(name, [*ODD, *(t for _, t in EDGE)])
    rng = np.random.default_rng(11)
    encodes_like_the_library(name, ["".join(rng.choice(ALPHABET, n)) for n in rng.integers(1, 40, 4000)])
    points = rng.integers(1, 0x2FFFF, (500, 30))
    encodes_like_the_library(name, ["".join(chr(c) if c % 3 and not 0xD800 <= c < 0xE000 else " " for c in row) for row in points.tolist()])
    import pyarrow.parquet as pq

    encodes_like_the_library(name, pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist())


def test_packing(spark, edge, empty):
    spec = registry.tokenizer("byte_bpe_50k.json")
    rows = packing.pack(edge, spec).collect()
    got = collections.defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for i, t in EDGE:
        ids = ids_of("byte_bpe_50k.json", t, 0)
        parts = sorted(set(got[i]))
        assert [p[1] for p in parts] == np.cumsum([0, *(p[2] for p in parts)])[:-1].tolist()
        assert sum(p[2] for p in parts) == len(ids) and all(p[2] == 2048 for p in parts[1:])
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in parts)
    used = collections.defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= 2048
    assert len(used) <= math.ceil(sum(r.length for r in rows) / 2048) + 1
    assert packing.pack(empty, spec).count() == 0


def test_best_fit_is_the_tightest():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 300)
    sequence, place = packing.best_fit_decreasing(lengths, 100)
    rooms, want = [], []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        i = min(fits)[1] if fits else len(rooms)
        rooms += [100] * (not fits)
        rooms[i] -= n
    assert len(set(sequence.tolist())) == len(rooms) and sorted(100 - np.bincount(sequence, lengths).astype(int)) == sorted(rooms)
    assert (place + lengths <= 100).all() and not want


def test_token_files(spark, edge, empty):
    spec = registry.tokenizer("word_bpe_49k.json")
    rows = sorted(tokenfile.round_trip(edge, spec).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in EDGE), key=lambda i: (i is not None, i))
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    want = {i: ids_of("word_bpe_49k.json", t, 1) for i, t in EDGE}
    assert all(r.n_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(want[r.doc_id].tobytes()) for r in rows)
    assert tokenfile.round_trip(empty, spec).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((1, 0), (5, 3), (1000, 100), (1000, 10**7)):
        ends = np.sort(rng.integers(0, top + 1, n))
        ids = rng.integers(0, 60_000, int(ends[-1])).astype(np.uint32)
        back, ef = tokenfile.unpack_shard(tokenfile.pack_shard(ids, ends))
        assert (back == ids).all() and (ef.get(0, n) == ends).all()
        assert all(ef.get(a, b).tolist() == ends[a:b].tolist() for a, b in ((0, 1), (n // 2, n), (n - 1, n)))
        assert 8 * (len(ef.low) + len(ef.high)) <= n * (3 + max(0, math.log2((top + 1) / n))) + 64


def test_media(spark, edge, empty):
    rows = media.digest(media.media_table(edge)).collect()
    for r in rows:
        raw = next((t or "" for i, t in EDGE if i == r.doc_id)).encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len(rows) == len(EDGE) and media.digest(media.media_table(empty)).count() == 0


@pytest.mark.parametrize("n", [64, 128, 169, 170, 183, 184, 185, 16_384, 16_448, 100_032])
def test_stream_round_trip(n):
    payload = bytes(i * 7 % 256 for i in range(n))
    data = media.mux(payload)
    s = media.demux(data)
    units = -(-n // media.UNIT_BYTES)
    assert (s.payload, s.lost, s.times, s.access) == (payload, 0, [k * media.UNIT_TICKS for k in range(units)], list(range(0, units, media.KEY_UNITS)))
    if units > 1:
        cut = data[: 188 * 10] + data[188 * 11 :]
        assert media.demux(cut).lost == 1
    with pytest.raises(ValueError):
        media.demux(b"\0" + data[1:])


def brute_repeats(rows):
    order = [(math.inf if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in order:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], math.inf))
    out = []
    for i, b in order:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return collections.Counter(out)


def test_suffix_dedup(spark, edge, empty):
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("ab "), 4000))
    rows = [*EDGE, *((20 + k, base[a : a + n] + "#" + base[b : b + n]) for k, (a, b, n) in enumerate(rng.integers(40, 900, (12, 3)).tolist()))]
    got = suffixdedup.repeats(make(spark, rows), "kept_sha256", config=suffixdedup.Config(bucket_bytes=4000, block_bytes=3000, part=700))
    assert collections.Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute_repeats(rows)
    kept = suffixdedup.repeats(edge)
    assert set(edge.columns) < set(kept.columns) and kept.count() == len(EDGE) and suffixdedup.repeats(empty).count() == 0


def test_deep_shallow_sorts():
    rng = np.random.default_rng(4)
    buf = rng.integers(97, 99, 3000).astype(np.uint8)
    buf[1000:1500] = buf[:500]
    buf[2000:2300] = 98
    starts = np.arange(len(buf) - 50)
    group = np.sort(rng.integers(0, 5, len(starts)))
    first = np.append(True, np.diff(group) > 0)
    symbols = suffixdedup.strings(buf, starts, np.full(len(starts), 50), 56)
    for shallow in (1, 2, 4, 7):
        order, new = suffixdedup.deep_shallow(symbols, first, shallow)
        texts = [(group[s], buf[s : s + 50].tobytes()) for s in order]
        assert sorted(order.tolist()) == list(range(len(starts)))
        assert texts == sorted(texts) and new.tolist() == [True, *(a != b for a, b in zip(texts, texts[1:], strict=False))]


def test_blind_trie():
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(0, 3, 12).tolist()) for _ in range(500)]
    trie = suffixdedup.BlindTrie()
    for i, t in enumerate(texts):
        trie.add(t, i)
    groups = list(trie.ordered())
    assert [texts[g[0]] for g in groups] == sorted(set(texts)) and all(len({texts[i] for i in g}) == 1 for g in groups)
    assert sorted(i for g in groups for i in g) == list(range(500))


def shingle_set(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset([tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def test_jaccard_join_finds_every_link(spark, empty):
    rng = np.random.default_rng(5)
    rows = list(EDGE)
    for g in range(12):
        base = [f"g{g}x{i}" for i in range(120)]
        for k in range(12):
            w = list(base)
            for j in rng.integers(0, 120, rng.integers(0, 5)).tolist():
                w[j] = f"c{k}"
            rows.append((100 + 20 * g + k, " ".join(w)))
    got = {r.doc_id: r for r in jaccardjoin.join(make(spark, rows), jaccardjoin.Config(limit=5, bunch=100)).collect()}
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    distinct = sorted({s for s in sets.values() if s}, key=sorted)
    near = {s: {t for t in distinct if t != s and 9 * len(s & t) >= 4 * (len(s) + len(t))} for s in distinct}
    for i, s in sets.items():
        assert got[i].n_links == len(near.get(s, ())), i
        group, open_ = {s}, [s]
        while open_ and s:
            for t in near[open_.pop()] - group:
                group.add(t)
                open_.append(t)
        assert got[i].class_id == (min(j for j, t in sets.items() if t in group) if s else i)
    assert jaccardjoin.join(empty).count() == 0


def test_jaccard_join_of_many_near_copies(spark):
    """A class of 900 different copies, with some at the edge of the threshold and a second class that leans on it."""
    rng = np.random.default_rng(6)
    rows, base = [], [f"t{i}" for i in range(200)]
    other = base[:176] + [f"u{i}" for i in range(24)]
    for k in range(1000):
        w = list(base if k < 900 else other)
        for j in rng.integers(0, 200, rng.choice([1, 2, 3, 7])).tolist():
            w[j] = f"k{k}x{j}"
        rows.append((k, " ".join(w)))
    docs, config = make(spark, rows), jaccardjoin.Config(limit=40, bunch=2000)
    got = {r.doc_id: r for r in jaccardjoin.join(docs, config).collect()}
    sets = [shingle_set(t) for _, t in rows]
    number = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        held[i, [number[x] for x in s]] = 1
    both, size = held @ held.T, held.sum(axis=1)
    near = (9 * both >= 4 * (size[:, None] + size[None, :])) & ~np.eye(len(sets), dtype=bool)
    assert near.sum() > 200_000 and (~near[:900, :900]).sum() > 10_000
    # meeting in a bucket is a matter of chance: no link is made up, and of all links the stated share is found
    links, true = np.array([got[i].n_links for i in range(len(sets))]), near.sum(axis=1)
    assert (links <= true).all() and links.sum() >= config.recall * true.sum()
    label = np.arange(len(sets))
    for _ in range(len(sets)):
        label = np.minimum(label, np.where(near, label[None, :], len(sets)).min(axis=1))
    assert [got[i].class_id for i in range(len(sets))] == label.tolist()


def test_certain_links_need_no_buckets(spark):
    """Rows of buckets grow with a class's sets and not with their square, and certain links are links."""
    rng = np.random.default_rng(7)
    counts = []
    for m in (400, 1600):
        rows = []
        for k in range(m):
            w = [f"t{i}" for i in range(200)]
            for j in rng.integers(0, 200, 2).tolist():
                w[j] = f"k{k}x{j}"
            rows.append((k, " ".join(w)))
        config = jaccardjoin.Config(limit=40)
        held = jaccardjoin.sets(make(spark, rows), config).cache()
        signed = held.where("sig is not null").groupBy("set_id").agg(F.first("sig").alias("sig")).cache()
        _, large = jaccardjoin.leaves(spark, signed, config)
        most = pivots.reach(config.threshold)
        nodes = pivots.named_nodes(large, signed).cache()
        far = pivots.distances(large, nodes, held.where("shingles is not null")).cache()
        found = pivots.certain_links(far, most).agg(F.sum("links")).first()[0]
        assert far.count() > 0.95 * m and found > 0.9 * m * (m - 1)
        counts.append(pivots.buckets(large, nodes, far, most, config.limit).count())
    assert counts[1] <= 8 * max(counts[0], 400)


def test_decontamination(spark, edge, empty):
    items = spark.createDataFrame([(1, WORDS), (2, "one shared passage that is quite a bit longer than fifty bytes"), (3, None), (4, "two words"), (5, " ".join(f"W{i}," for i in range(20, 55)) + " z"), (6, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.search(edge, items).collect()}
    assert got == {(4, 1), (None, 1), (6, 1), (7, 1), (4, 5), (None, 5), (6, 5), (4, 2), (5, 2), (None, 2), (7, 5)}
    few = spark.createDataFrame([(1, "A!"), (2, "w3, w4"), (3, "w4 w3"), (4, "fifty bytes so that"), (5, "...")], "item_id long, text string")
    short = {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in decontaminate.search(edge, few).collect()}
    # "a" is a word of the passage, too
    assert short == {*((d, 1, 1, 1) for d in (3, 4, 5, None)), *((d, 2, 1, 1) for d in (4, None, 6, 7)), *((d, 4, 1, 1) for d in (4, 5, None))}
    assert decontaminate.search(empty, items).count() == 0 and decontaminate.search(edge, items.limit(0)).count() == 0
    assert {r.doc_id for r in decontaminate.clean(edge, items).collect()} == {i for i, _ in EDGE} - {d for d, _ in got}


def test_licences(spark, edge, empty):
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, "the license of the car"), (3, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."), (4, None), (5, "permission to license " * 50)]
    model = licences.train()
    got = {r.doc_id: [h.family for h in r.hits] for r in licences.scan(make(spark, rows), model).collect()}
    assert got == {1: ["MIT"], 2: [], 3: ["Apache-2.0", "CC-BY-NC-4.0"], 4: [], 5: []}
    # against the model itself, line by line, without telling words
    rng = np.random.default_rng(8)
    lines = []
    for _ in range(250):
        family = str(rng.choice(model.families[:-1]))
        w = licences.tokens(str(rng.choice(licences.TEMPLATES[family])))
        w = [x for x in w if rng.random() > 0.08] + [str(x) for x in rng.choice(["the", "work", "file", "under", "license", "mit", "free"], rng.integers(0, 5))]
        lines.append(" ".join(w[rng.integers(0, 3) :]))
    want = {}
    for i, line in enumerate(lines):
        p, w = model.probabilities(line), licences.tokens(line)
        family, three = model.families[int(p.argmax())], {" ".join(w[k : k + 3]) for k in range(len(w) - 2)}
        shares = [len(three & s) / len(s) for t in licences.TEMPLATES.get(family, ()) for x in [licences.tokens(t)] for s in [{" ".join(x[k : k + 3]) for k in range(len(x) - 2)}] if s]
        if family != licences.UNKNOWN and p.max() >= 0.5 and max(shares, default=0) >= 0.75:
            want[i] = (family, round(float(p.max()), 3))
    got = {r.doc_id: [(h.family, round(h.probability, 3)) for h in r.hits if h.probability != h.overlap or h.family == want.get(r.doc_id, ("",))[0]] for r in licences.scan(make(spark, list(enumerate(lines))), model).collect()}
    assert len(want) > 100 and all(want[i] in got[i] for i in want)
    assert licences.scan(edge, model).where(F.size("hits") > 0).count() == 0 and licences.scan(empty, model).count() == 0


def test_suffix_tree(spark, edge, empty):
    for docs, rows in ((edge, EDGE), (make(spark, EDGE[:3]), EDGE[:3])):
        got = sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in suffixtree.score(docs, registry.remainder(7) != 2).collect())
        tokens = [[*re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())), None] for _, t in rows]
        c = collections.Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if i is not None and remainder(i, 7) != 2 for w in ws)
        n, v = sum(c.values()), len(c)
        want = sorted((len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for ws in tokens)
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    assert suffixtree.score(empty, F.lit(True)).count() == 0 and suffixtree.score(edge, F.lit(False)).count() == len(EDGE)


def test_suffix_tree_is_the_brute_force_model(spark):
    """Every score against a slow model, and the probabilities of the words after a start add up to 1 at most."""
    rng = np.random.default_rng(12)
    vocabulary = ["a", "ab", "ba", "bb", "aab", "abba"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 30), p=[0.4, 0.2, 0.2, 0.1, 0.05, 0.05])) for _ in range(120)] + ["abba zz a", "zz zz", ""]
    config = suffixtree.Config(depth=3, least_share=1e-3, bucket_rows=50)
    learnt = [t for i, t in enumerate(texts) if i % 3 and i < 120]
    got = {r.doc_id: r.score for r in suffixtree.score(make(spark, list(enumerate(texts))), (F.col("doc_id") % 3 != 0) & (F.col("doc_id") < 120), config).collect()}
    stream = [b"   " + "".join(w + " " for w in t.split()).encode() + b" " for t in learnt]
    n = collections.Counter(s[i - k : i + 1] for s in stream for i in range(3, len(s)) for k in range(4))
    total = sum(c for g, c in n.items() if len(g) == 1)
    after = lambda c: {g[-1]: v for g, v in n.items() if len(g) == len(c) + 1 and g[:-1] == c}

    def kept(c):
        if len(c) <= 1:
            return bool(after(c))
        own, up = after(c), after(c[1:])
        m, mu = sum(own.values()), sum(up.values())
        test = 2 * sum(v * math.log(v / m * mu / up[x]) for x, v in own.items())
        return m >= 1e-3 * total and test > max(1, len(own) - 1) * math.log(total)

    grams = {g[:-1] for g in n if len(g) > 1}
    states = {c[i:] for c in grams if kept(c) for i in range(len(c))}

    def p(c, x):
        if not c:
            return (n[bytes([x])] + 1) / (total + 256)
        own = after(c)
        return (own.get(x, 0) + len(own) * p(c[1:], x)) / (sum(own.values()) + len(own))

    words = collections.Counter(w for t in learnt for w in [*t.split(), None])
    scale = sum(words.values()) + len(words) + 1

    def word(before, w):
        s, q = before, 1.0
        for x in ((w or "") + " ").encode():
            q *= p(next((s[-k:] for k in (3, 2, 1) if s[-k:] in states), b""), x)
            s += bytes([x])
        return 0.5 * q + 0.5 * (words[w] + 1) / scale, s

    for i, t in enumerate(texts):
        s, want = b"   ", 0.0
        for w in [*t.split(), None]:
            q, s = word(s, w)
            want += math.log10(q)
        assert abs(got[i] - want) < 1e-4 * max(1, abs(want)), (i, got[i], want)
    for before in (b"   ", b"  ab ", b"bba "):
        assert sum(word(before, w)[0] for w in [*words, "zz"]) <= 1 + 1e-9


def test_suffix_tree_beats_words_on_held_out_texts(spark):
    r = registry.op2_suffix_tree(spark, SF).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_language(spark, edge, empty):
    docs = registry.table(spark, SF, "documents")
    r = registry.op4_langid(spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert r.where("lang_pred = lang").count() >= 0.97 * r.count()
    model = langid.fit(edge, F.lit(True), langid.Config(epochs=1))
    got = langid.predict(edge, model).collect()
    assert len(got) == len(EDGE) and {x.lang_pred for x in got if x.doc_id in (0, 1, 2)} == {"und"} and langid.predict(empty, model).count() == 0
    assert langid.predict(edge, langid.fit(empty, F.lit(True))).where("lang_pred <> 'und'").count() == 0


def test_toxicity(spark, edge, empty):
    labels = registry.table(spark, SF, "labels")
    r = registry.op1_toxicity(spark, SF).join(labels, "doc_id").select("score", "toxic").toPandas()
    rank, y = r.score.rank(), r.toxic == 1
    assert (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum()) > 0.9
    model = toxicity.fit(edge, labels.limit(0), F.lit(True))
    assert toxicity.score(edge, model).where("score = 0").count() == len(EDGE) and toxicity.score(empty, model).count() == 0
