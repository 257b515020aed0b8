"""Each operator against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import contextlib
import hashlib
import io
import math
import random
import re
import threading
import zipfile
import zlib
from collections import Counter

import numpy as np
import psutil
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell import session
from tidewell.llm import chat, components, decontam, filters, mixing, pii, quality, queries, repair, secrets, simhash, tokens, toxicity, warczip

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, row string, fingerprint string, n int"
FOLDER = "/root/testdata/sf0.001"


def documents(spark, texts, start=0):
    rows = [(start + k, t, "en" if k % 3 else None, f"s{k % 2}" if k % 5 else None, None, 1.0, 2, "r", "f", 3) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


WORDS = "the of and river stone cloud ethics über naïve 数据 42nd".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", ",", ".", ""]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [None, "", " \n\t ", "One", "a b c", "a b c d", "A B C D"]
    out += [prose(rng, n) for n in (3, 9, 10, 50, 200, 700)]
    long = prose(rng, 8_000)
    out += [long, long, long.replace("river", "stone", 2), "x" * 200_000, "a " * 9_000, "é" * 5, "😀 mail me@x.org 😀", "line\nline\n\nline \n"]
    return out + out[7:9]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return documents(spark, texts).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 10 ----------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", w) if x]
    hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def plain_components(ids, prints, radius=4):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    low = {}
    for i, x in zip(ids, label):
        low[x] = min(low.get(x, i), i)
    return [low[x] for x in label]


def test_simhash_equals_brute_force(docs, texts, none):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [got[k][0] for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[k][1] for k in range(len(texts))] == plain_components(list(range(len(texts))), prints)
    assert simhash.near_duplicates(none).count() == 0


def test_links_of_clusters_and_hot_keys(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(6)]
    hot = [int(base[0]) ^ (1 << int(i)) ^ (1 << int(j)) for i in range(24) for j in range(24, 40)]
    values = sorted({*map(int, base), *near, *hot})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    nodes = spark.createDataFrame(list(zip(signed, range(len(values)))), "fp long, node long").repartition(3)
    assert [simhash.blocks_for(n) for n in (0, 1 << 18, 1 << 23, 1 << 27, 1 << 33)] == [6, 6, 6, 7, 8]
    for chunk, blocks in ((16, None), (2048, 8)):
        links = simhash.links(nodes, chunk=chunk, blocks=blocks)
        component = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
        assert [component.get(k, k) for k in range(len(values))] == plain_components(list(range(len(values))), values)


def test_one_row_of_each_class_stays(spark, docs, texts, none):
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs.union(docs)).select("doc_id").collect())
    assert kept == sorted(set(plain_components(list(range(len(texts))), [plain_fingerprint(t) for t in texts])))
    nameless = documents(spark, ["p q r s t", "p q r s t", "p q"]).withColumn("doc_id", F.lit(None).cast("long"))
    out = simhash.drop_near_duplicates(nameless)
    assert out.columns == docs.columns and out.count() == 2 and simhash.drop_near_duplicates(none).count() == 0


def test_components_of_chains(spark):
    n = 60
    links = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(100, 100), (None, 5), (201, 200), (200, 201)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    assert got == {**{k: 0 for k in range(n + 1)}, 200: 200, 201: 200}
    assert components.connected_components(links.filter("a > 999")).count() == 0


# 7 -----------------------------------------------------------------------------------------------------------------


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_token_shards_equal_the_tokenizer(spark, docs, texts, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    at, want = 0, []
    for k, t in enumerate(texts):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tokens.encode_and_read_back(docs, vocabulary()).collect())) == want
    assert tokens.encode_and_read_back(none, vocabulary()).count() == 0


@pytest.mark.parametrize("text", ["It's <|endoftext|>x 'S don't", "İstanbul ΣΑΣ ſtop ǅ ªº", "éa ́b café.", "a\tb\r\nc d e", "12 34th x1.5,", "。、 中文,字.", "A.,b..", "ÀÉ Ĳ ŉ \U0001d54f", "word\x1cword \x85 y"])
def test_encoder_on_odd_texts(text):
    from tokenizers import Tokenizer

    import public_tokenizers

    for path in (vocabulary(), public_tokenizers.path("byte_bpe_50k.json")):  # the second keeps case and white space
        enc = tokens.Encoder(path)
        ids, sizes = enc.encode(pa.array([text, None, text]).slice(0, 3))
        want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want * 2 and sizes.tolist() == [len(want), 0, len(want)]
        assert enc.by_piece == (path == vocabulary())


def test_encoder_on_random_chunks_with_a_small_cache():
    from tokenizers import Tokenizer

    rng = random.Random(31)
    parts = ["a", "Ü", "ß", "ª", "'s", "'", "\"", "(", "),", "...", "1", "é", "<|", "|>", "endoftext", "中", "İ", " ", "\n", "\t", "-", "!?", "don't", "µm", "\u0301"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    enc, plain = tokens.Encoder(vocabulary(), cache=50), Tokenizer.from_file(vocabulary())
    for at in range(0, 600, 97):
        ids, sizes = enc.encode(pa.array(texts[at : at + 97]))
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts[at : at + 97]]
        assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == list(map(len, want))


def test_shards_of_hot_ids_and_many_files(spark, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    rows = [(None, t) for t in texts] + [(5, t) for t in texts] + [(-3, "x y")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    import tempfile

    path = f"file://{tempfile.mkdtemp()}/s"
    tokens.write_shards(table, vocabulary(), path, shard_ids=300, file_bytes=20_000)
    places = tokens.shard_places(spark, path)
    assert places.select("part").distinct().count() > 3 and places.count() > 20
    got = sorted(tokens.read_shards(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * len(texts) + [-3] + [5] * len(texts)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    size = lambda t: len(plain.encode(t or "", add_special_tokens=False).ids) + 1
    assert sorted(r["n_tokens"] for r in got if r["doc_id"] is None) == sorted(map(size, texts))


def test_files_keep_every_byte(spark, tmp_path):
    from tidewell.llm import binfiles

    frames = [bytes(range(256)) * 3, b"", b"\n\r\n", bytes(range(255, -1, -1))]
    binfiles.write_frames(spark.createDataFrame([(f,) for f in frames], "frame binary").coalesce(1), str(tmp_path / "b"))
    (row,) = binfiles.files(spark, str(tmp_path / "b")).collect()
    with binfiles.RangeFile(row["path"]) as file:
        assert file.read(0, file.size) == b"".join(f + b"\n" for f in frames)


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(3)
    raw = (rng.zipf(1.3, 60_000) % 3000).astype(np.uint32)
    for base in (49408, 70000):
        rules, seq = repair.compress(raw, base)
        assert np.array_equal(repair.expand(seq, rules, repair.sizes_of(rules, base), base), raw) and len(rules) > 50
        assert max(Counter(zip(seq[:-1].tolist(), seq[1:].tolist())).values()) < repair.MIN_COUNT


@pytest.mark.parametrize("ids", [[], [7], [5] * 1001, [1, 2] * 500, list(range(100)) * 40, list(np.random.default_rng(1).integers(0, 6, 20000))])
def test_grammar_round_trip(ids):
    raw = np.array(ids, np.uint32)
    for base in (49408, 70000):
        rules, seq = repair.compress(raw, base)
        for way in (repair.expand, repair.expand_all):
            assert np.array_equal(way(seq, rules, repair.sizes_of(rules, base), base), raw)
        shard = tokens.Shard(tokens.pack_shard([None, 4], np.array([len(raw), 0]), raw, base))
        for a, b in ((0, len(raw)), (3, 9), (len(raw) // 2, len(raw) // 2 + 77), (-5, 2), (9, 3)):
            assert np.array_equal(shard.range(a, b), raw[max(a, 0) : b] if b > a else raw[:0])
    if len(ids) > 10000:
        assert len(seq) < 0.7 * len(raw)


def test_ranges_touch_few_rules(spark, docs, texts):
    rng = np.random.default_rng(9)
    words = [rng.integers(0, 40_000, 6) for _ in range(60)]
    raw = np.concatenate([words[k] for k in rng.integers(0, 60, 20_000)]).astype(np.uint32)
    shard = tokens.Shard(tokens.pack_shard([1], np.array([len(raw)]), raw, 49408))
    everything = set()
    assert np.array_equal(repair.expand(shard.seq, shard.rules, shard.sizes, shard.base, touched=everything), raw)
    assert shard.sizes.tolist() == repair.sizes_of(shard.rules, shard.base).tolist() and len(everything) >= 300
    for a, b in ((0, 1), (61_234, 61_240), (len(raw) - 3, len(raw))):
        touched = set()
        assert np.array_equal(shard.range(a, b, touched), raw[a:b])
        assert 0 < len(touched) < 60
    path = session.scratch(spark, "shards")
    import public_tokenizers

    file = public_tokenizers.path("word_bpe_49k.json")
    tokens.write_shards(docs, file, path, shard_ids=3000)
    found = {r["doc_id"]: r["ids"] for r in tokens.read_documents(spark, path, [3, 9, 12, 10_000]).collect()}
    enc = tokens.encoder(file)
    assert found == {k: [*enc.tokenizer.encode(texts[k] or "", add_special_tokens=False).ids, tokens.END_ID] for k in (3, 9, 12)}


def test_damaged_shard_raises():
    data = bytearray(tokens.pack_shard([1], np.array([3]), np.array([5, 6, 7], np.uint32), 49408))
    data[-8] ^= 1
    with pytest.raises(ValueError):
        tokens.Shard(bytes(data))


# 1 -----------------------------------------------------------------------------------------------------------------


def labelled(spark, n=900):
    rng = random.Random(9)
    bad = ["grolx", "vrimble", "snurgeful", "snurging", "snurge"]
    rows = []
    for k in range(n):
        words = prose(rng, rng.randint(20, 90)).split()
        toxic = k % 5 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad[:3] if k % 2 else bad))
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    e, trans = rng.normal(size=(6, 3)), rng.normal(size=(2, 2))
    p, pairs = toxicity.marginals(e, trans, pairs=True)
    want, total = np.zeros_like(e), np.zeros((2, 2))
    for s in range(3):
        z, mass, moves = 0.0, np.zeros(6), np.zeros((2, 2))
        for code in range(64):
            y = [code >> k & 1 for k in range(6)]
            w = np.exp(sum(e[k, s] * y[k] for k in range(6)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            z += w
            mass += w * np.array(y)
            for a, b in zip(y, y[1:]):
                moves[a, b] += w
        want[:, s], total = mass / z, total + moves / z
    assert np.allclose(p, want) and np.allclose(pairs, total)


def test_whole_text_chains_equal_enumeration():
    rng = np.random.default_rng(6)
    for span in (2, 3, 32):
        lengths, trans = np.array([5, 0, 1, 9, 4, 0]), rng.normal(size=(2, 2))
        e = rng.normal(size=19) * 3
        got, at = toxicity.text_marginals(e, lengths, trans, span), 0
        for n in lengths:
            own, mass, z = e[at : at + n], np.zeros(n), 0.0
            for code in range(1 << n) if n else ():
                y = [code >> k & 1 for k in range(n)]
                w = np.exp(own @ y + sum(trans[a, b] for a, b in zip(y, y[1:])))
                z, mass = z + w, mass + w * np.array(y)
            assert n == 0 or np.allclose(got[at : at + n], mass / z)
            at += n
    long = rng.normal(size=5000)
    assert np.allclose(toxicity.text_marginals(long, np.array([5000]), trans), toxicity.marginals(long[:, None], trans)[:, 0])


def test_scores_equal_chains_word_by_word():
    rows = [(t, y) for _, t, y in labelled(None, 400)]
    model = toxicity.fit(rows, 0.2)
    texts = [t.replace(" ", "  ", 1) for t, _ in rows[:40]] + [None, "", " \n ", "grolx", " ".join(t for t, _ in rows[:90])]
    scores, spans = toxicity.Scorer(model, cache=60).documents(texts)
    for k, t in enumerate(texts):
        words = [c for c in re.split("[ \n\t\r]", t or "") if c]
        own = [sum(model.weights[i] for i in toxicity.features(c)) for c in words]
        side = lambda m, c: model.weights[toxicity._hash(m + (toxicity.core(c) if c else "")) >> (32 - toxicity.BITS)]
        e = np.array([o + side("<", words[i - 1] if i else "") + side(">", words[i + 1] if i + 1 < len(words) else "") for i, o in enumerate(own)])
        p = toxicity.marginals(e[:, None], model.trans)[:, 0] if words else np.zeros(1)
        top = sorted([*p, 0.0], reverse=True)
        z = model.document @ [1, np.log1p(p.sum()), top[0], top[1]]
        assert abs(scores[k] - 1 / (1 + math.exp(-z))) < 2e-3
        assert sum(len(re.split("[ \n\t\r]+", t[s["start"] : s["end"]])) for s in spans[k]) == int((p >= 0.5).sum()) if words else not spans[k]


def test_toxicity_held_out_accuracy_and_spans(spark, none, docs):
    rows = labelled(spark)
    table = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y, "clash") for k, _, y in rows] + [(0, 1, "again"), (None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, text string")
    model = toxicity.train(table, labels)
    got = {r["doc_id"]: r for r in toxicity.score(table, model).collect()}
    held = [(k, t, y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    right = sum((got[k]["score"] >= 0.5) == (y == 1) for k, _, y in held)
    assert right >= 0.97 * len(held)
    for k, t, y in held[:40]:
        for s in got[k]["spans"]:
            assert re.match("grolx|vrimble|snurg", t[s["start"] : s["end"]])
    assert toxicity.score(docs, model).filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(none, model).count() == 0
    clean = toxicity.drop_toxic(documents(spark, [t for _, t, _ in rows]), model)
    assert clean.columns == docs.columns and abs(clean.count() - 720) <= 20


def test_toxicity_without_labels(spark, docs):
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).filter("score >= 0.5").count() == 0


# 6 -----------------------------------------------------------------------------------------------------------------


def test_contamination_equals_brute_force(spark, docs, texts, none):
    rng = random.Random(11)
    item = prose(rng, 25)
    bodies = [*texts, "Before " + item.upper() + " after", item[: len(item) // 2], "the of and", item + " " + item]
    items = [(1, item), (1, item), (2, "Stone, cloud! THE"), (3, None), (4, "..."), (10, " ".join(item.split()[3:16])), (None, "zebra")]
    table = documents(spark, bodies)
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    want = []
    windows = {("" if i is None else str(i), tuple(w[k : k + 10])) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - 9))}
    for k, body in enumerate(bodies):
        w, hit, ids = words(body), set(), set()
        places = {}
        for at, x in enumerate(w):
            places.setdefault(x, []).append(at)
        for i, win in windows:
            for at in places.get(win[0], []):
                if tuple(w[at : at + len(win)]) == win:
                    hit |= set(range(at, at + len(win)))
                    ids.add(i)
        want.append((k, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    for bits in (filters.MOST_BITS, filters.LEAST_BITS, 8):  # a filter that is too small lets runs through that the join drops
        got = decontam.digest(decontam.contamination(table, bench, most_bits=bits))
        assert sorted(map(tuple, got.collect())) == want
    kept = decontam.drop_contaminated(table, bench)
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == [k for k, *_, bad in want if not bad]
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).filter("size(hits) > 0").count() == 0


@contextlib.contextmanager
def worker_memory():
    """How much the resident memory of each Python worker grows meanwhile, at most."""
    first, grown, done = {}, {}, threading.Event()

    def watch():
        while not done.wait(0.1):
            for p in psutil.Process().children(recursive=True):
                with contextlib.suppress(psutil.Error):
                    if "pyspark.daemon" in " ".join(p.cmdline()):
                        now = p.memory_info().rss
                        grown[p.pid] = max(grown.get(p.pid, 0), now - first.setdefault(p.pid, now))

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        yield grown
    finally:
        done.set()
        thread.join()


def test_large_benchmark_stays_out_of_workers(spark):
    # over a million windows: the filter has its largest size, and no worker of the documents' stages holds more than it
    rng = np.random.default_rng(3)
    item = lambda n: " ".join(map("w{:x}".format, rng.integers(0, 1 << 22, n)))
    items = [item(1200) for _ in range(1000)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string").repartition(8)
    bodies = [item(200), "x " + " ".join(items[7].split()[5:40]) + " y", item(50) + " " + " ".join(items[999].split()[-10:]), items[0]]
    with worker_memory() as grown:
        got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontam.digest(decontam.contamination(documents(spark, bodies), bench)).collect()}
    assert got == {0: (0, 0), 1: (35, 1), 2: (10, 1), 3: (1200, 1)}
    assert 0 < max(grown.values()) < 300e6


def test_filters_never_deny(spark):
    keys = [f"k{k}".encode() for k in range(5000)]
    known = filters.build(spark.createDataFrame([(k,) for k in keys], "key binary").repartition(4))
    assert known.has(keys).all() and known.has([f"n{k}".encode() for k in range(5000)]).mean() < 0.01
    assert not filters.build(spark.createDataFrame([], "key binary")).has([b"a", b""]).any()


# 3 -----------------------------------------------------------------------------------------------------------------


def test_sainte_lague_equals_highest_quotients(spark):
    rng = random.Random(8)
    groups = {g: [rng.choice([0, 1, 5, 40, 333, 10_000]) for _ in range(rng.randint(1, 12))] for g in range(30)}
    seats = {g: rng.randint(0, 400) for g in groups}
    rows = spark.createDataFrame([(g, k, float(v), seats[g]) for g, vs in groups.items() for k, v in enumerate(vs)], "g int, k int, vote double, seats int")
    got = {(r["g"], r["k"]): r["won"] for r in mixing.apportion(rows, ["g"], "vote", F.col("seats"), [F.col("k")]).collect()}
    for g, vs in groups.items():
        won = [0] * len(vs)
        for _ in range(seats[g] if sum(vs) else 0):
            won[max(range(len(vs)), key=lambda k: (vs[k] / (2 * won[k] + 1), -k))] += 1
        assert [got[g, k] for k in range(len(vs))] == won


def test_mix_meets_targets_and_bounds(spark, docs, texts, none):
    for shard in (500,):
        rows = mixing.mix(docs, shard_words=shard).collect()
        assert len(rows) == len(texts) and rows != []
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
        by = Counter()
        for r in rows:
            by[r["target"], r["source_size"]] += r["taken"]
        assert all(abs(n - t) <= 16 * (2 + s / shard) for (t, s), n in by.items())
        assert abs(sum(t for t, _ in by) - 1.5 * sum(r["size"] for r in rows)) < 1e-6
    again = sorted(map(tuple, mixing.mix(docs.repartition(3), shard_words=500).collect()), key=str)
    assert again == sorted(map(tuple, rows), key=str)
    assert mixing.mix(none).count() == 0
    empty = mixing.mix(documents(spark, [None, "", " "])).collect()
    assert len(empty) == 3 and all(r["taken"] == 0 for r in empty)


def test_blocks_are_drawn_by_seed(spark):
    rng = random.Random(14)
    texts = [prose(rng, rng.randint(0, 90)) for _ in range(400)]
    texts[7] = prose(rng, 3000)
    rows = [(k, t, "a" if k % 3 else "b", "x") for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, row string")
    count = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t))
    for block, stretch, shard, group in ((16, 2, 900, 2), (4, 8, 100_000, 1024)):
        sizes = mixing.sized(table)
        plan = mixing.source_plan(sizes, block, shard)
        placed = mixing._placed(sizes, plan)
        quotas = {(r["skey"], r["shard"]): r for r in mixing.shard_plan(placed, block, group).collect()}
        where = {r["doc_id"]: (r["skey"], r["shard"]) for r in placed.collect()}
        won = {r["skey"]: r["won"] for r in plan.collect()}
        for s in won:
            assert sum(q["quota"] for k, q in quotas.items() if k[0] == s) <= won[s] * block
        want = {}
        for key, q in quotas.items():
            own = sorted((k for k in where if where[k] == key), key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())
            line = [k for k in own for _ in range(count(texts[k]))]
            assert len(line) == q["line"]
            parts = [line[at : at + block * stretch] for at in range(0, len(line), block * stretch)]
            order = sorted(range(len(parts)), key=lambda k: hashlib.md5(f"42:{key[0]}:{key[1]}:{k}".encode()).hexdigest())
            taken = Counter({k: q["quota"] // max(1, len(line)) * n for k, n in Counter(line).items()})
            rest = q["quota"] % len(line) if line else 0
            for k in order:
                taken.update(parts[k][:rest])
                rest -= min(rest, len(parts[k]))
            want |= {k: taken[k] for k in own}
        if group == 1024:
            got = {r["doc_id"]: r["taken"] for r in mixing.mix(table, block, shard, stretch).collect()}
            assert got == want
            out = Counter()
            for r in mixing.mixture(table, block, shard, stretch).collect():
                out[r["doc_id"]] += count(r["text"])
                assert set(r["text"].split()) <= set(texts[r["doc_id"]].split())
            assert dict(out) == {k: n for k, n in want.items() if n}


def test_groups_of_shards_share_a_hot_source(spark):
    rng = random.Random(15)
    rows = [(k, rng.randint(1, 500), rng.randrange(300)) for k in range(3000)]
    placed = spark.createDataFrame([("=a", s, n, 40_000) for _, n, s in rows], "skey string, shard long, size long, won long")
    got = {r["shard"]: r["quota"] for r in mixing.shard_plan(placed, 16, 32).collect()}
    line = Counter()
    for _, n, s in rows:
        line[s] += n
    total = sum(line.values())
    assert all(abs(got[s] - min(2 * n, 16 * 40_000 * n / total)) <= 40 for s, n in line.items())


def test_mixture_holds_what_the_mix_takes(docs):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(re.findall("[^\x20\x09-\x0d]+", r["text"]))
    assert dict(got) == {k: n for k, n in taken.items() if n}


# 2 -----------------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    same = "é" * 60
    rows = [(3, "http://a/ b\r\n", same), (1, None, same), (2, "u", same), (7, "u", "short"), (8, "u", "short"), (9, "u", None), (None, "n", same), (1, "u", same), (20, "u", "z" * 2_000_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, size int").repartition(3)
    got = sorted(map(tuple, warczip.archive_and_read_back(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = h == same and i != 1
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=str)
    assert warczip.archive_and_read_back(pages.limit(0)).count() == 0
    out = str(tmp_path / "w")
    warczip.write_archives(pages, out, member_bytes=1000)
    read = warczip.read_records(spark, out).filter("record_type = 'response'").select("page_id", "payload")
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in read.collect()} == {(1, same), (7, "short"), (8, "short"), (9, ""), (20, "z" * 2_000_000)}
    for f in (tmp_path / "w").glob("part-*"):
        if f.stat().st_size:
            with zipfile.ZipFile(f) as z:  # a plain reader agrees
                assert z.testzip() is None and all(i.compress_type == 0 for i in z.infolist())


def test_zip64_directory(tmp_path):
    w = warczip.ZipWriter(gap=0)
    data = w.member("a", b"one")
    w.entries[0] = (w.entries[0][0], w.entries[0][1], w.entries[0][2], 0xFFFFFFFF + 10)
    end = w.close()
    assert b"PK\6\6" in end and b"PK\6\7" in end
    p = tmp_path / "big.zip"
    with open(p, "wb") as f:  # a sparse file: the member lies beyond four gigabytes
        f.seek(0xFFFFFFFF + 10)
        f.write(data)
        w.at = f.tell()
        f.write(w.close())
    with warczip.RangeFile(str(p)) as f:
        (m,) = warczip.members(f)
        assert f.read(m.offset, m.length) == b"one"
    with zipfile.ZipFile(p) as z:
        assert z.read("a") == b"one"


def test_members_of_other_writers(tmp_path):
    p = tmp_path / "x.zip"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("stored.txt", "abc", zipfile.ZIP_STORED)
        z.writestr("packed.txt", "abc" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6 in a comment"
    with warczip.RangeFile(str(p)) as f:
        assert [(m.name, f.read(m.offset, m.length)) for m in warczip.members(f)] == [("stored.txt", b"abc")]
    (tmp_path / "no.zip").write_bytes(b"not a package")
    with warczip.RangeFile(str(tmp_path / "no.zip")) as f, pytest.raises(ValueError):
        warczip.members(f)


def test_rows_without_ids_are_spread_over_shards(spark):
    rows = spark.createDataFrame([(None, f"word{k} and more words here", "s") for k in range(3000)], "doc_id long, text string, source string")
    sizes = mixing.sized(rows)
    placed = mixing._placed(sizes, mixing.source_plan(sizes, shard_words=600))
    per = [r["n"] for r in placed.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(per) == 25 and max(per) < 2 * 600


# 4 -----------------------------------------------------------------------------------------------------------------


def plain_pii(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for rank, (kind, p) in enumerate(patterns.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(int(x) for x in m.group().split(".")) > 255:
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(12)
    alphabet = ["@", ".", "a", "b-", "_", "%", "+", "1", "22", "255", "300", " ", "-", "(", ")", "4111111111111111", "é", "\n", "a@b.c", "1.2.3.4", "+1 (415) 555-1234"]
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24)))
        assert pii.base_spans(t) == plain_pii(t), t
    for t in ("9" * 100_000, "a" * 100_000 + "@", "1." * 50_000, "+1(" * 30_000, "@" * 50_000):
        pii.base_spans(t)


def test_field_adds_spelled_forms_and_leaves_prose(spark, docs, none):
    rng = random.Random(13)
    rows = []
    for k in range(300):
        d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
        rows.append(f"{prose(rng, 12)} {rng.choice(['ann', 'bob.k', 'x_y'])}{d(2)}@mail{d(1)}.example.com {prose(rng, 9)} +1 ({d(3)}) 555-{d(4)} {prose(rng, 8)} 10.{rng.randint(0, 255)}.3.{rng.randint(0, 255)} {prose(rng, 5)} 4111111111111111 at the end")
    field = pii.train(documents(spark, rows))
    assert pii.added_spans("please write to ann42 at mail3 dot example dot com today", [], field)
    assert pii.added_spans("call (415) 555-1234 now", [], field)
    clean = [prose(rng, 300) for _ in range(20)] + ["version 2.0, page 12 of 300, in 2024 at 10 the dot is at end"]
    assert not [t for t in clean if pii.added_spans(t, pii.base_spans(t), field)]
    out = pii.find(docs, field).collect()
    assert {r["doc_id"]: r["n_email"] for r in out if r["n_email"]} == {19: 1}
    assert pii.find(none, field).count() == 0 and len(out) == docs.count()


def test_semi_markov_posteriors_equal_enumeration():
    field = pii.Field(np.random.default_rng(5).normal(size=len(pii._FEATURES)))
    text = "call 415 555 1234 or"
    rows, post, bounds, z = field.posteriors(text)
    n = len(bounds) - 1
    total, mass = 0.0, {}

    def walk(at, score, used):
        nonlocal total
        if at == n:
            total += np.exp(score)
            for u in used:
                mass[u] = mass.get(u, 0.0) + np.exp(score)
            return
        walk(at + 1, score, used)
        for k, r in enumerate(rows):
            if r[0] == at:
                for kind, s in enumerate(field.scores(*r[2:])):
                    walk(r[1], score + s, [*used, (k, kind)])

    walk(0, 0.0, [])
    assert np.isclose(np.log(total), z)
    assert all(np.isclose(post[k][kind], m / total) for (k, kind), m in mass.items())


def test_best_path_and_posteriors_equal_enumeration():
    rng = np.random.default_rng(6)
    for text in ("call 415 555 1234 or", "a 12.34 b 5678", "x at me dot org 4321", "(12) 34-56, 7.8.9.1 end"):
        field = pii.Field(rng.normal(size=len(pii._FEATURES)))
        n, rows, bounds = field.lattice(text)
        paths = []

        def walk(at, score, used):
            if at == n:
                paths.append((score, used))
                return
            walk(at + 1, score, used)
            for r in rows:
                if r[0] == at:
                    for kind, s in enumerate(field.scores(*r[2:])):
                        walk(r[1], score + s, [*used, (bounds[r[0]], kind, bounds[r[1]])])

        walk(0, 0.0, [])
        total = sum(np.exp(s) for s, _ in paths)
        want = max(paths, key=lambda p: p[0])
        got = field.best(text)
        assert [x[:3] for x in got] == want[1] and rows
        for *span, p in got:
            assert np.isclose(p, sum(np.exp(s) for s, used in paths if tuple(span) in used) / total)
        # the cut by posterior keeps exactly those that reach it and touch no base span
        base = pii.base_spans(text)
        free = [tuple(x[:3]) for x in got if x[3] >= pii.POSTERIOR and not any(b[0] < x[2] and x[0] < b[2] for b in base)]
        assert pii.added_spans(text, base, field) == free


def test_long_ranges_are_not_cut():
    field = pii.Field(np.random.default_rng(8).normal(size=len(pii._FEATURES)))
    rng = random.Random(8)
    text = "".join(rng.choice(["12", "345 ", "-", ". ", "(", "word ", "6789", " at x dot org "]) for _ in range(1500))
    assert list(pii.regions(text)) == [(0, len(text))]
    n, rows, bounds = field.lattice(text)
    post, _ = field._marginals(rows, n)
    known = {(bounds[r[0]], k, bounds[r[1]]): p for r, own in zip(rows, post) for k, p in enumerate(own)}
    best = field.best(text)
    assert len(best) > 50 and all(np.isclose(known[tuple(x[:3])], x[3]) for x in best)
    for anchor in range(0, len(text), 97):
        assert pii._before(text, anchor) == (m := [x.start() for x in pii._TOKEN.finditer(text[:anchor][::-1])], anchor - (m[pii.MAX_TOKENS] if len(m) > pii.MAX_TOKENS else anchor))[1]


# 5 -----------------------------------------------------------------------------------------------------------------


def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32])


def test_secret_spans(spark, docs, none):
    rng = random.Random(21)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    b64 = lambda n: "".join(rng.choice(secrets.ALPHABETS["base64"][:64]) for _ in range(n))
    bodies = [f"😀 Password = \"{hexes(20)}\" x", "secret:token:abcdefgh1", "API_KEY=short api-key=abcdefghijk apikey='abcdefghijk'", "AKIA" + "Z9" * 8, "AKIAshort", f"é{hexes(40)}é {hexes(31)}", f"see {b64(60)} there", "thisisaverylongwordthatgoesonandonandon", "0123456789" * 4, "aaaaaaaa11111111aaaaaaaa11111111bbbb" + "Z", None, "", prose(rng, 3000), "token=" * 2000]
    got = {r["doc_id"]: r for r in secrets.find(documents(spark, bodies)).collect()}
    for k, t in enumerate(bodies):
        spans = sorted((s["start"], s["rank"], s["end"]) for c in ("assign", "access", "hex") for s in got[k][c])
        assert spans == plain_secrets(t or ""), t
    assert [(s["start"], s["end"]) for s in got[6]["random"]] == [(4, 64)]
    assert not [k for k in (7, 8, 9, 12) if got[k]["random"]]
    assert secrets.digest(secrets.find(none)).count() == 0 and secrets.find(docs).count() == docs.count()
    first = secrets.digest(secrets.find(documents(spark, bodies[:1]))).first()
    want = ",".join(f"{secrets.KINDS[r]}:{s}:{e}" for s, r, e in plain_secrets(bodies[0]))
    assert first["spans"] == want and first["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def plain_bits(value):
    """Evidence of a candidate in bits and the battery's joint p-value in bits, with exact normal tails."""
    kind = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", value) else "base32" if re.fullmatch("[A-Z2-7]+=*", value) else "base64"
    body = value.lower() if kind == "hex" else value.replace("-", "+").replace("_", "/").rstrip("=")
    size, n = len(secrets.ALPHABETS[kind]), len(body)
    x = [secrets.ALPHABETS[kind].index(c) for c in body]
    if not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
        mixed = False
    else:
        mixed = True
    natural = lambda c: math.log2(0.9 * secrets.LETTERS[ord(c.lower()) - 97] / 1000) - 5 * c.isupper() if c.isalpha() else math.log2(0.003) if c.isdigit() else math.log2(0.02)
    bits = sum(-math.log2(size) - natural(c) for c in body)
    tail = lambda z: max(math.erfc(z / math.sqrt(2)) / 2, 1e-300)
    m = max(2, min(size, n // 5))
    seen, share = Counter(v * m // size for v in x), [(-(-(k + 1) * size // m) + -(-k * size // -m) * 0 - -(-k * size // m)) / size for k in range(m)]
    chi = sum((seen[k] - n * share[k]) ** 2 / (n * share[k]) for k in range(m))
    logs = [math.log(tail(((chi / (m - 1)) ** (1 / 3) - (1 - 2 / (9 * (m - 1)))) / math.sqrt(2 / (9 * (m - 1)))))]
    high = [2 * v >= size for v in x]
    ones, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:]))
    e = 2 * ones * (n - ones) / n + 1
    logs.append(min(0, math.log(2 * tail(abs(runs - e) / math.sqrt(max((e - 1) * (e - 2) / (n - 1), 1e-9))))) if 0 < ones < n else (1 - n) * math.log(2))
    d = [v - sum(x) / n for v in x]
    total = sum(v * v for v in d)
    logs.append(min(0, math.log(2 * tail(abs(sum(a * b for a, b in zip(d, d[1:]))) / total * math.sqrt(n)))) if total else (1 - n) * math.log(size))
    t = -sum(logs)
    q = (math.log(1 + t + t * t / 2) - t) / math.log(2)
    return (bits + q if mixed else 0.0), q


def test_battery_and_false_discovery_control(spark):
    rng = random.Random(33)
    b64 = lambda n: "".join(rng.choice(secrets.ALPHABETS["base64"][:62]) for _ in range(n))
    words = ["internationalization", "counterrevolutionaries", "the-quick-brown-fox-jumps-over-2-dogs", "a1b2c3d4e5f6g7h8i9j0k1l2", "Z" * 30 + "9", "0123456789abcdefghijklmnopqrstuvwxyz"]
    bodies = [f"{rng.choice(words)} and {b64(rng.randint(20, 70))} {rng.choice(words)}{k}" if k % 3 == 0 else f"{rng.choice(words)} {rng.choice(words)}_{k}" for k in range(150)]
    bodies += ["see apitok=" + b64(60) + " there", "some_very_long_configuration_name=" + b64(44) + "== x", None, ""]
    spans = [[(m.start(), m.end(), *plain_bits(m.group())) for m in re.finditer(secrets.CANDIDATE, t or "")] for t in bodies]
    got = {r["doc_id"]: {(s["start"], s["end"]) for s in r["random"]} for r in secrets.find(documents(spark, bodies)).collect()}
    line = lambda bits, rate: min((b for k, b in enumerate(bits) if b > 0.5 and 2.0**-b <= rate * (k + 1) / len(bits)), default=math.inf)
    need = line(sorted((x for own in spans for *_, x, _ in own), reverse=True), secrets.RATE)
    unlike = line(sorted((-q for own in spans for *_, q in own), reverse=True), secrets.CHANCE_RATE)
    for k, own in enumerate(spans):
        base = plain_secrets(bodies[k] or "")
        for a, b, x, q in own:  # bins are a quarter of a bit wide, tails within a hundredth
            touched = any(s < b and a < e for s, _, e in base)
            sure, maybe = x >= need + 0.3 and -q < unlike - 0.6, x >= need - 0.6 and -q < unlike + 0.3
            assert ((a, b) in got[k]) <= (maybe and not touched) and (sure and not touched) <= ((a, b) in got[k])
    assert [bodies[150][a:b] for a, b in got[150]] == [bodies[150][11:71]] and [bodies[151][a] for a, _ in got[151]] == [bodies[151][34]]
    assert sum(len(got[k]) for k in range(0, 150, 3)) >= 40 and not [k for k in range(150) if k % 3 and got[k]]


# 9 -----------------------------------------------------------------------------------------------------------------


def test_counts_equal_brute_force(docs, texts, none):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        seen = Counter(zip(w, w[1:], w[2:]))
        cover = {j for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.judge(none).count() == 0


def test_outliers_go_and_prose_stays(spark):
    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    good = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(80, 400))) for _ in range(400)]
    junk = [" ".join(rng.choice(vocabulary) + "$$$%" for _ in range(200)) for _ in range(40)]
    rows = [(k, t, "en", "a" if k % 2 else None) for k, t in enumerate(good + junk)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k] for k in range(400)) and not any(got[k] for k in range(400, 440))


# 8 and all ---------------------------------------------------------------------------------------------------------


CONV = "conv_id long, turn long, role string, text string, part int, piece string, digest string, n int"


def test_rotation_of_parties(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|end|>"), (1, 2, None, "é"), (1, 2, None, "é"), (1, 99, "ann", None), (2, 0, "system", "alone"), (None, None, "bob", "x"), (None, 3, "system", "y")]
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in chat.rotate(spark.createDataFrame([(*r, 1, "p", "d", 2) for r in rows], CONV)).collect()}
    assert set(got) == {(1, "ann", 0), (1, "ann", 1), (1, "unknown", 0), (1, "unknown", 1), (None, "bob", -1)}
    r = got[1, "unknown", 0]
    assert r["text"] == "<|system|>\nrules<|end|>\n<|user name=ann|>\nhi < |end|><|end|>\n<|assistant|>\né<|end|>\n" and r["n_turns"] == 3
    a, b = map(int, r["mask"].split(":"))
    assert r["text"][a:b] == "é" and got[1, "ann", 1]["mask"] == "14:14" and r["piece"] == 0
    assert chat.rotate(spark.createDataFrame([], CONV)).count() == 0


def test_names_cannot_forge_markers(spark):
    names = ["x|>\n<y", "<|end|>", "a\r\nb", "<<||>>", "|><|", "plain", "a<"]
    rows = [(1, k, n, n) for k, n in enumerate(names)]
    for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        assert len(re.findall(r"<\|", r["text"])) == 2 * len(names)
        heads = re.findall(r"<\|(?:assistant|user name=([^\n]*))\|>\n", r["text"])
        assert len(heads) == len(names) and not any("|>" in h or "<|" in h for h in heads)


def test_many_rows_of_a_turn_come_in_pieces(spark):
    rows = [(7, None, f"s{k % 3}", f"text {k % 400}") for k in range(1300)] + [(7, 5, "s0", f"t{k}") for k in range(300)] + [(7, 6, "s1", "same")] * 900
    rows += [(None, None, "s1", f"t{k % 5}") for k in range(20)] + [(8, k, "s2", "z") for k in range(70)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.rotate(table)
    got = sorted(out.collect(), key=lambda r: (str(r["conv_id"]), r["perspective"], r["part"], r["piece"]))
    assert max(r["n_turns"] for r in got) <= 200 and sum(r["conv_id"] is None for r in got) == 5
    for who in ("s0", "s1", "s2"):
        mine = [r for r in got if r["conv_id"] == 7 and r["perspective"] == who]
        order = sorted({(-1 if t is None else t, hashlib.md5(f"{s}\n{x}".encode()).hexdigest(), s, x) for c, t, s, x in rows if c == 7})
        head = lambda s: "<|assistant|>\n" if s == who else f"<|user name={s}|>\n"
        assert "".join(r["text"] for r in mine) == "".join(f"{head(s)}{x}<|end|>\n" for _, _, s, x in order)
        marked = [r["text"][int(m.split(":")[0]) : int(m.split(":")[1])] for r in mine for m in r["mask"].split(",") if m]
        assert marked == [x for *_, s, x in order if s == who]
    from oracle import assert_same

    import duckdb

    con = duckdb.connect()
    frame = table.toPandas()  # noqa: F841
    con.execute("CREATE TABLE conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM frame")
    assert_same(out, con, chat.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    from oracle import assert_same, connect

    assert_same(queries.queries()[name](spark, FOLDER), connect(FOLDER), queries.oracle_sql()[name])
