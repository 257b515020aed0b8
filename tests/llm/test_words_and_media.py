"""Resampling, collocations and media columns against brute force, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import audio, collocations, importance

SCHEMA = "doc_id long, text string, lang string, source string, n long, rank int, media string, audio int, key string"
WORDS = "the of The and river stone OF cloud ethics über naïve 数据 42nd x".split()


def prose(rng, n, marks=("", "", ",", ".", "\n", " \t")):
    return " ".join(rng.choice(WORDS) + rng.choice(marks) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = [None, "", " \n\t ", "One", "... !?", "a b c a b c", "é" * 700, "\x7f\x00 nul", "x" * 60_000, "river stone " * 400, prose(rng, 9_000)]
    texts += [prose(rng, n) for n in (1, 2, 19, 20, 21, 60, 400, 900, 575, 576)]
    out = [(k, t, rng.choice(["en", "de", None, "und", ""]), "s", 1, 2, "m", 3, "k") for k, t in enumerate(texts)]
    return out + out[12:15] + [(None, "the river stone " * 9, "en", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# 12 ----------------------------------------------------------------------------------------------------------------


def plain_resample(rows, target, least, most, buckets, seed, least_words, percent):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t))
    features = lambda w: [" ".join(w[k : k + n]) for n in range(least, most + 1) for k in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for r in rows:
        s.update(map(bucket, features(split(r[1]))))
    for x in target:
        t.update(map(bucket, features(split(x))))
    ss, tt = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets))))
    out = []
    for r in rows:
        own = features(split(r[1]))
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in own)
        out.append([r[0], len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(split(r[1]))])
    may = sorted((x for x in out if x[4] >= least_words), key=lambda x: (-x[3], x[0] is not None, x[0]))
    return out, [tuple(x[:4]) for x in may[: len(may) * percent // 100]]


@pytest.mark.parametrize("least,most,size", [(1, 1, importance.BLOCK_WORDS), (1, 1, 50), (1, 2, 64), (2, 3, 1000)])
def test_resampling_equals_brute_force(spark, docs, rows, least, most, size):
    target = ["river stone cloud", None, "", "ethics ethics of the river " * 8]
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, key int")
    got = importance.resample(docs, aim, least, most, 50, 7, 20, 40, size).collect()
    want, drawn = plain_resample(rows, target, least, most, 50, 7, 20, 40)
    by = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((tuple(r[:4]) for r in got), key=by) == sorted((tuple(x[:4]) for x in want), key=by)
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [tuple(r[:4]) for r in ranked] == drawn


def test_resampling_of_empty_tables(docs, none):
    assert importance.resample(none, docs).count() == 0
    got = importance.resample(docs, none).collect()
    assert len(got) == docs.count() and all(r["n_features"] or r["weight"] == 0 for r in got)


# 13 ----------------------------------------------------------------------------------------------------------------


def plain_phrases(rows, least, longest, share, top):
    f, n = Counter(), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split("[.,;:!?\n-\r]", lowered(r[1])):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[k : k + m])) for m in range(1, longest + 1) for k in range(len(words) - m + 1))
    own = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in own.items():
        inside = (b for (other, v), b in own.items() if other == lang and len(v) > len(w) and any(v[k : k + len(w)] == w for k in range(len(v))))
        if any(100 * b >= share * a for b in inside):
            continue
        cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for k, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


@pytest.mark.parametrize("least,longest,share,top,bits", [(10, 3, 50, 2000, None), (3, 4, 50, 2000, 5), (2, 3, 20, 7, 8), (300, 3, 50, 2000, 4)])
def test_phrases_equal_brute_force(docs, rows, least, longest, share, top, bits):
    got = sorted(tuple(r) for r in collocations.mine(docs, least, longest, share, top, bits).collect())
    assert got == plain_phrases(rows, least, longest, share, top) and got


def test_sketch_never_counts_too_little(spark, docs, rows):
    texts = docs.select(F.coalesce("lang", F.lit("und")).cast("binary"), F.coalesce("text", F.lit("")).cast("binary"))
    table = collocations.sketch(texts, 12, 3)
    words = collocations.Words()
    for r in rows:
        words.add(("und" if r[2] is None else r[2]).encode(), (r[1] or "").encode())
    for _, _, hashes in collocations.runs(words, words.flat(), 3):
        exact = Counter(hashes.tolist())
        est = np.min([table[k, collocations.cells(hashes, k, 12)] for k in range(collocations.ROWS)], axis=0)
        assert all(e >= min(exact[h], collocations.FULL) for h, e in zip(hashes.tolist(), est.tolist()))


def test_phrases_of_empty_tables(none, docs):
    assert collocations.mine(none).count() == 0
    assert collocations.mine(docs.limit(0).withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_scores_of_large_counts(spark):
    # products far beyond 64 bits stay exact
    a, left, right = 3_000_000_019, 3_000_000_101, 9_999_999_967
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    got = row.select(F.expr(f"(({wide('a')} * {wide('a')}) * 1000000BD) div ({wide('l')} * {wide('r')})")).first()[0]
    assert got == 1000000 * a * a // (left * right)


# 11 ----------------------------------------------------------------------------------------------------------------


def test_payloads_come_back(docs, rows, none):
    got = {}
    for r in audio.store_and_read_back(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for key, text, *_ in rows:
        raw = (text or "").encode()
        whole = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        for r in got[key]:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest())
            assert r["tail_crc32"] == zlib.crc32(whole[-32:]) and r["media_bytes"] > 0
            assert f"samples={len(whole)} Xing={len(whole) // 576}/" in r["feature"] and "table_ok=True whole_ok=True skipped=0 resyncs=0" in r["feature"]
    assert sum(map(len, got.values())) == len(rows) and all(len({tuple(r) for r in x}) == 1 for x in got.values())
    assert audio.store_and_read_back(none).count() == 0


def frame(version, layer, kbps, rate, mode=0, ext=0, protected=False, fill=0, pad=0):
    """A frame built bit by bit."""
    index = audio.BIT_RATES[version == "1", layer].index(kbps) + 1
    base = {"1": 1, "2": 2, "2.5": 4}[version]
    word = 0x7FF << 21 | {"1": 3, "2": 2, "2.5": 0}[version] << 19 | (4 - layer) << 17 | (not protected) << 16
    word |= index << 12 | audio.SAMPLE_RATES.index(rate * base) << 10 | pad << 9 | mode << 6 | ext << 4
    length = audio.header(word).length
    return word.to_bytes(4, "big") + bytes([fill]) * (length - 4)


def test_headers_and_lengths():
    # known lengths of frames
    for args, length, samples in (
        (("1", 3, 128, 44100), 417, 1152),
        (("1", 3, 320, 48000), 960, 1152),
        (("2", 3, 64, 22050), 208, 576),
        (("2.5", 3, 8, 8000), 72, 576),
        (("1", 2, 192, 44100), 626, 1152),
        (("1", 1, 384, 44100), 416, 384),
    ):
        raw = frame(*args)
        h = audio.header(int.from_bytes(raw[:4], "big"))
        assert (len(raw), h.samples, h.rate) == (length, samples, args[3])
    for word in (0xFFFFFFFF, 0xFFFB0000, 0xFFFBF000, 0xFFFB9C00, 0xFFF9B000 & 0xFFF9FFFF & ~0x60000, 0xFFEB9000, 0):
        assert audio.header(word) is None


def bit_crc(bits):
    """The frame checksum by its definition."""
    crc = 0xFFFF
    for b in bits:
        crc = ((crc << 1) ^ (0x8005 if (crc >> 15 & 1) != b else 0)) & 0xFFFF
    return crc


def bits_of(raw):
    return [x >> k & 1 for x in raw for k in range(7, -1, -1)]


def sealed(raw, protected_bits):
    """``raw`` with its checksum over header and the given number of bits after the checksum."""
    crc = bit_crc(bits_of(raw[2:4]) + bits_of(raw[6:])[:protected_bits])
    return raw[:4] + crc.to_bytes(2, "big") + raw[6:]


def test_checksums_of_all_layers():
    rng = random.Random(2)
    own = []
    for mode, ext in ((0, 0), (1, 2), (3, 0)):
        raw = frame("1", 1, 256, 48000, mode, ext, True)
        raw = raw[:6] + rng.randbytes(len(raw) - 6)
        own.append(sealed(raw, 128 if mode == 3 else 256 if mode == 0 else 4 * (32 + 4 * (ext + 1))))
        raw = frame("1", 3, 128, 44100, mode, ext, True)
        own.append(sealed(raw[:6] + rng.randbytes(len(raw) - 6), 8 * (17 if mode == 3 else 32)))
        # layer II, table a: 4 bits of 11 subbands, 3 of 12, 2 of 4, then two bits for each that has an allocation
        raw = frame("1", 2, 80 if mode == 3 else 160, 44100, mode, ext, True)
        raw = raw[:6] + rng.randbytes(len(raw) - 6)
        bits, at, chosen, bound = bits_of(raw[6:]), 0, 0, 12 if mode == 1 else 27
        for k in range(27):
            width = 4 if k < 11 else 3 if k < 23 else 2
            for _ in range(1 if mode == 3 or k >= bound else 2):
                if any(bits[at : at + width]):
                    chosen += 2 if k >= bound and mode != 3 else 1
                at += width
        own.append(sealed(raw, at + 2 * chosen))
    for raw in own:
        good, bad = raw * 3, raw + raw[:6] + bytes([raw[6] ^ 1]) + raw[7:] + raw
        a, b = audio.Batch.of([good, bad]).reports()
        assert (a["frames"], a["crc_checked"], a["crc_failed"]) == (3, 3, 0)
        assert (b["crc_checked"], b["crc_failed"]) == (3, 1)


def test_resynchronising_tags_and_tables(spark):
    one = frame("1", 3, 128, 44100)
    loud = frame("1", 3, 160, 44100, pad=1)
    junk = b"\xff\xfb\x90 no frame \xff\xff\xe0"
    v2 = b"ID3\x03\0\0" + bytes([0, 0, 0, 21]) + b"TIT2" + struct.pack(">IH", 6, 0) + b"\0Title" + bytes(5)
    v1 = b"TAG" + b"Old".ljust(30, b"\0") + b"Band".ljust(30, b"\0") + bytes(65)
    item = struct.pack("<II", 5, 0) + b"Genre\0prose"
    ape = item + b"APETAGEX" + struct.pack("<IIII", 2000, len(item) + 32, 1, 0) + bytes(8)
    vbri = bytearray(frame("1", 3, 128, 44100))
    vbri[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 1500, 2, 2, 1, 2, 1)
    vbri[62:66] = struct.pack(">HH", 417, 523)
    values = [v2 + one + loud + junk + one * 2 + ape + v1, bytes(vbri) + one * 2, b"", b"\xff" * 5000, junk, one[:-1], None, one]
    data = spark.createDataFrame([(k, bytearray(v) if v is not None else None, k) for k, v in enumerate(values)], "id int, media binary, audio int")
    got = {r["id"]: r["audio"] for r in audio.probe(data).collect()}
    first = got[0]
    assert (first["frames"], first["samples"], first["resyncs"], first["skipped"]) == (4, 4 * 1152, 1, len(junk))
    assert first["tags"] == {"TIT2": "Title", "title": "Old", "artist": "Band", "Genre": "prose"}
    at = len(v2)
    assert first["offsets"] == [at, at + 417, at + 417 + len(loud) + len(junk), at + 834 + len(loud) + len(junk)]
    assert (first["least_kbps"], first["most_kbps"], first["seconds"]) == (128, 160, 4 * 1152 / 44100)
    assert (got[1]["table"], got[1]["table_frames"], got[1]["toc"], got[1]["frames"]) == ("VBRI", 2, [417, 523], 2)
    assert got[6] is None and got[7]["frames"] == 1
    assert all(got[k]["frames"] == 0 and got[k]["skipped"] == len(values[k]) for k in (2, 3, 4, 5))


def test_damage_is_seen():
    rng = np.random.default_rng(1)
    text = ("plain words and " * 300 + " ".join("no größe at all".split()[k] for k in rng.integers(0, 4, 1000))).encode()
    (media,) = audio.encoded([text])
    (good,) = audio.Batch.of([media]).reports()
    assert good["crc_failed"] == 0 and good["whole_ok"] and good["table_ok"] and good["least_kbps"] < good["most_kbps"]
    at = good["offsets"][5]
    side, body = bytearray(media), bytearray(media)
    side[at + 8] ^= 4
    body[at + 200] ^= 4
    a, b = audio.Batch.of([bytes(side), bytes(body)]).reports()
    assert (a["crc_failed"], a["whole_ok"]) == (1, False) and (b["crc_failed"], b["whole_ok"]) == (0, False)
    lost = media[:at] + b"\0" * 40 + media[at + 40 :]
    (c,) = audio.Batch.of([lost]).reports()
    assert (c["frames"], c["resyncs"], c["whole_ok"]) == (good["frames"] - 1, 1, False)
    # delay and padding come off the samples, and the tables' own checksum is of the frame before it
    p = media.index(b"tidewell1") + 21
    trimmed = media[:p] + (576 << 12 | 100).to_bytes(3, "big") + media[p + 3 :]
    (d,) = audio.Batch.of([trimmed]).reports()
    assert d["samples"] == good["samples"] - 676 and d["table_ok"] is False
