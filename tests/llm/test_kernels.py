"""Kernels against plain versions."""

import itertools
import math
import random
import re
import struct
import tracemalloc

import numpy as np
import pytest
import xxhash

from glyphloom.llm import kneser, media, packing, secrets, simhash


def arrays(texts):
    e = [t.encode() for t in texts]
    return np.frombuffer(b"".join(e), np.uint8), np.cumsum([0] + [len(x) for x in e])


def test_fingerprints():
    r = random.Random(1)
    texts = ["", "a", "a b c", "A B  c\td e", " x y z w v \n"] + [" ".join(r.choice(["é", "foo", "Bar", "z"]) for _ in range(r.randint(0, 40))) for _ in range(50)]

    def plain(t):
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << j for j in range(64) if 2 * sum(v >> j & 1 for v in h) > len(h))

    assert simhash.text_fingerprints(*arrays(texts)).tolist() == [plain(t) for t in texts]


@pytest.mark.parametrize("n,flips", [(40, 3), (600, 5), (1500, 2), (900, 30)])
def test_bucket_links(n, flips):
    rng = np.random.default_rng(n)
    fp = rng.integers(0, 1 << 63, 4).astype(np.uint64)[rng.integers(0, 4, n)]
    for _ in range(flips):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    fp = np.unique(fp)
    cut = len(fp) // 3
    start, size = np.array([0, cut]), np.array([cut, len(fp) - cut])
    got = simhash.bucket_links(fp, start, size, tasks=500)
    want = np.arange(len(fp))
    for i in range(len(fp)):
        lo, hi = (0, cut) if i < cut else (cut, len(fp))
        j = lo + np.flatnonzero(np.bitwise_count(fp[lo:hi] ^ fp[i]) <= 4)
        simhash._settle(want, np.full(len(j), i), j)
    assert (got == want).all()


def test_masks_cover_every_pair():
    r = random.Random(2)
    for k in (1, 2, 3):
        ms = simhash.masks(0, 4, k)
        for _ in range(300):
            flips = sum(1 << b for b in r.sample(range(64), 4))
            assert any(not flips & m for m in ms)
    shared = ms[0]
    finer = simhash.masks(shared, 4, 2)
    free = [b for b in range(64) if not shared >> b & 1]
    for _ in range(300):
        flips = sum(1 << b for b in r.sample(free, 4))
        assert any(not flips & m for m in finer)


def test_lower_bound_and_best_fit():
    r = random.Random(3)
    for _ in range(200):
        sizes = np.array([r.randint(1, 12) for _ in range(r.randint(1, 7))])
        bins, offsets, free = packing.best_fit(sizes, 12)
        least = next(k for k in itertools.count(1) if any(all(sum(s for s, b in zip(sizes, p, strict=True) if b == j) <= 12 for j in range(k)) for p in itertools.product(range(k), repeat=len(sizes))))
        assert packing.lower_bound(sizes, 12) <= least <= len(free)
        for b in range(len(free)):
            own = sorted((o, s) for o, s, k in zip(offsets, sizes, bins, strict=True) if k == b)
            assert sum(s for _, s in own) + free[b] == 12
            assert all(a + s == c for (a, s), (c, _) in itertools.pairwise(own)) and own[0][0] == 0


def test_encoders_agree(texts):
    odd = ["", " ", "a  b\n\n c", "don't we'll 123 4x5", "<|endoftext|>", "naïve Straße ñ", "x" * 3000, "\t\tif x:\r\n"]
    full, _ = packing._encoders(packing.VOCABULARY, packing.RANKS)
    for t in odd + [t for _, t in texts[:20]]:
        assert next(packing.encode([t], [True])).tolist() == full.encode(t, add_special_tokens=False).ids


def test_added_tokens():
    """Ids are those of the vocabulary's own tokenizer, its added tokens among them."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.VOCABULARY)
    for t in ["<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>", "<|endoftext|", "é <|endoftext|> ñ", "漢 <|endoftext|> 字", "plain text, no token"]:
        want = own.encode(t, add_special_tokens=False).ids
        assert [i.tolist() for i in packing.encode([t, t], [max(map(ord, t)) < 0x250, False])] == [want, want]
        assert want.count(50256) == t.count("<|endoftext|>")


def test_telephone_codecs():
    assert media.MULAW[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0] and media.ALAW[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    for table in (media.MULAW, media.ALAW):
        assert (table[media.compress(table, table)] == table).all()
    x = (8000 * np.sin(np.arange(2000) / 9)).astype(np.int16)
    data = media.adpcm_encode(x, 64)
    got = media.adpcm_decode(data, 64)

    def plain(block):  # one sample after the other
        value, index = struct.unpack("<hB", block[:3])
        out = [value]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
                index = max(0, min(88, index + int(media.MOVES[code & 7])))
                out.append(value)
        return out

    assert got.tolist() == [v for i in range(0, len(data), 64) for v in plain(data[i : i + 64])]
    assert np.abs(got[: len(x)].astype(int) - x)[50:].mean() < 300
    m = media.wave(b"abc" * 21)
    assert bytes(media.wave_parts(m)[3]) == b"abc" * 21 and len(media.doubled(x)) == 4000
    # files of several formats together, blocks of two sizes, a last block cut short
    files = [(0x11, 8000, 64, memoryview(data)), (7, 8000, 1, memoryview(b"abc")), (0x11, 8000, 36, memoryview(media.adpcm_encode(x[:300], 36))), (0x11, 8000, 64, memoryview(data[:100])), (1, 8000, 2, memoryview(x.tobytes()))]
    many = media.samples(files)
    assert many[0].tolist() == got.tolist() and many[4].tolist() == x.tolist() and many[1].tolist() == media.MULAW[[97, 98, 99]].tolist()
    assert many[2].tolist() == media.adpcm_decode(bytes(files[2][3]), 36).tolist() and many[3].tolist() == plain(data[:64]) + plain(data[64:100])


def brute_guess_cost(v):
    """The cheapest segmentation by listing every span of every form."""
    words = secrets.dictionary()
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in v)
    leet = "".join({"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}.get(c, c) for c in low)
    keys = "".join("1234567890-=[]\\;,./`"["!@#$%^&*()_+{}|:<>?~".index(c)] if c in "!@#$%^&*()_+{}|:<>?~" else c for c in low)
    best = [0.0] + [math.inf] * len(v)
    for i in range(len(v)):
        for j in range(i + 1, len(v) + 1):
            n, cost = j - i, [float(j - i)]
            if n >= 3:
                cost += [words[low[i:j]] + 0.3 * (v[i:j] != low[i:j])] if low[i:j] in words else []
                cost += [words[leet[i:j]] + 1] if leet[i:j] in words else []
                for layout in range(3):
                    ways = [secrets.steps(layout).get(keys[k : k + 2]) for k in range(i, j - 1)]
                    if all(ways):
                        cost.append(math.log10(141) + math.log10(4.6) * (1 + sum(a != b for a, b in itertools.pairwise(ways))) + math.log10(n))
                if {ord(low[k + 1]) - ord(low[k]) for k in range(i, j - 1)} in ({1}, {-1}):
                    cost.append(math.log10(72 * n))
            cost += [math.log10(365 * 120 * 8)] if re.fullmatch(r"(19|20)[0-9]{2}[-/.]?[01]?[0-9][-/.]?[0-3]?[0-9]|[0-3]?[0-9][-/.]?[01]?[0-9][-/.]?(19|20)[0-9]{2}", v[i:j]) else []
            cost += [math.log10(120)] if re.fullmatch("(19|20)[0-9]{2}", v[i:j]) else []
            cost += [p + math.log10(n / p) for p in range(1, 9) if n >= max(2 * p, 3) and all(v[k] == v[k + p] for k in range(i, j - p))]
            best[j] = min(best[j], best[i] + min(cost) + math.log10(6))
    return best[-1]


def test_guess_cost():
    r = random.Random(7)
    pieces = "password zxcvbn monkey poiuytrewq queen aaaa abab 2021-03-04 31.12.1999 1999 P4ssw0rd x9 $kQ abcdef zyx 12345 qwe asd ABC lololo 7 - the 1qaz2wsx !QAZ é İ".split()
    values = ["password", "qwerty12", "x9$kq2", "p4ssword", "letmein!", "zxcvbnmonkey", "poiuytrewqueen"]
    values += ["".join(r.choice(pieces) for _ in range(r.randint(1, 5))) for _ in range(150)] + ["".join(r.choice("ab12qwsz") for _ in range(r.randint(1, 22))) for _ in range(150)]
    for v in values:
        want = brute_guess_cost(v)
        assert abs(secrets.guess_cost(v) - want) < 1e-9
        got = secrets.guess_cost(v, 8.0)
        assert (got >= 8) == (want >= 8) and (got >= 8 or abs(got - want) < 1e-9)
    assert secrets.guess_cost("password1") < 5 < secrets.guess_cost("x9$kQ2vTz7")


def test_guess_cost_of_long_values():
    """A long random value is settled at its start, a long run takes the memory of a few characters."""
    r = random.Random(8)
    assert secrets.guess_cost("".join(r.choice("abcXYZ019$%") for _ in range(2_000_000)), 8.0) >= 8
    run = "a" * 20_000
    secrets.guess_cost("aaaa", 8.0)
    tracemalloc.start()
    assert abs(secrets.guess_cost(run) - (1 + math.log10(6 * len(run)))) < 1e-9
    assert tracemalloc.get_traced_memory()[1] < 8 * len(run)
    tracemalloc.stop()


def test_guess_spans():
    text = "pwd => zxcvbnmonkey; passphrase: x9$kQ2vTz7 pin=1234567890 auth: 'Vq8%rL2#mZ0' client key = hunter2"
    want = [(text.index(v), text.index(v) + len(v), "guess") for v in ("x9$kQ2vTz7", "Vq8%rL2#mZ0") if brute_guess_cost(v) >= 8]
    assert len(want) == 2 and [s for s in secrets.find_spans(text) if s[2] == "guess"] == want
    assert all(brute_guess_cost(v) < 8 for v in ("zxcvbnmonkey", "1234567890", "hunter2"))


def test_spans():
    t = 'Password = "abc123def" token:short1 AKIA' + "A" * 16 + " " + "ab12" * 6 + " api_key=xx secret: a.b/c+d=e"
    got = secrets.find_spans(t)
    want = [(m.start(), m.end(), "assign") for m in re.finditer(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 6]
    assert [s for s in got if s[2] == "assign"] == want and sum(s[2] == "access" for s in got) == sum(s[2] == "hex" for s in got) == 1


def test_kneser_ney_sums_to_one():
    raw, off = arrays(["abracadabra", "abba", "cab"])
    cps, places, _ = kneser.text_sequences(raw, off, 3)
    k, at, n = np.unique(kneser.keys(cps, places, 3), return_index=True, return_counts=True)
    grams = np.stack([cps[places[at] - 2 + i] for i in range(3)], 1)
    model = kneser.kneser_ney([(grams, n)], ["x"], 3)
    seen = sorted(set(cps[places].tolist()))
    for ctx in ([97, 98], [98, 98], [99, 122], [kneser.START, 97]):
        seq = np.array([v for c in [*seen, 122] for v in (*ctx, c)], np.uint32)
        p = np.exp(model.log_probabilities(seq, np.arange(2, len(seq), 3)))[:, 0]
        assert abs(p.sum() - 1) < 1e-5 and (p > 0).all()


def test_sorted_keys():
    rng = np.random.default_rng(4)
    values = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) << np.uint64(1))
    k = kneser.SortedKeys(values)
    wanted = np.concatenate((values[::7], values[:50] + np.uint64(1)))
    assert (k.find(wanted) == np.concatenate((np.arange(0, len(values), 7), np.full(50, -1)))).all()
