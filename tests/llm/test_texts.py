"""Mixing, secret scans and winnowing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import mix, secrets, winnow


def test_mix_counts(messy):
    weights = {"src0": 0.5, "src1": 0.1}
    mixed = mix.mix_sources(messy, weights, 0.4, 3.0, seed=7)
    assert mixed.columns == [c for c in messy.columns if c != "mix_key"] + ["mix_rate", "mix_copy", "mix_key"]
    rows, sizes = messy.select("doc_id", "text", "source").collect(), {}
    group = lambda s: s if s in weights else None
    for r in rows:
        sizes[group(r.source)] = sizes.get(group(r.source), 0) + len(r.text or "")
    whole, want = sum(sizes.values()), {}
    for r in rows:
        g = group(r.source)
        rate = (weights.get(g, 0.4) * 3.0 * whole / sizes[g]) if sizes[g] else 0.0
        name = str(r.doc_id) if r.doc_id is not None else hashlib.md5((r.text or "").encode()).hexdigest()
        draws, n = max(1, math.ceil(rate / mix.DRAW_MEAN)), 0
        for j in range(1, draws + 1):
            u = (int(hashlib.md5(f"7|{j}|{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = total = math.exp(-rate / draws)
            k = 0
            while total < u and k < 400:
                k += 1
                p *= rate / draws / k
                total += p
            n += k
        want[(r.doc_id, r.text)] = want.get((r.doc_id, r.text), 0) + n
    got = {}
    for r in mixed.select("doc_id", "text").collect():
        got[(r.doc_id, r.text)] = got.get((r.doc_id, r.text), 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_mix_shares_and_large_rates(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', 10) AS text", "CASE WHEN id < 40 THEN 'rare' ELSE 'common' END AS source")
    mixed = mix.mix_sources(docs, {"rare": 0.9, "common": 0.1}, epochs=2.0)
    seen = {r.source: r.n for r in mixed.groupBy("source").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert abs(seen["rare"] - 7200) < 5 * math.sqrt(7200) and abs(seen["common"] - 800) < 5 * math.sqrt(800)
    keys = [r.mix_key for r in mixed.coalesce(1).select("mix_key").collect()]
    assert len(set(keys)) == len(keys) and keys != sorted(keys, key=lambda k: k)[::-1]


def test_mix_empty_and_weights(empty, messy):
    assert mix.mix_sources(empty, {"src0": 1.0}).collect() == []
    assert {r.source for r in mix.mix_sources(messy, {"src0": 1.0}, 0.0, 2.0).select("source").collect()} == {"src0"}
    with pytest.raises(ValueError):
        mix.mix_sources(messy, {"src0": 0.0})


def plain_spans(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            found.append(("assign", *m.span()))
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_spans_are_those_of_a_plain_search():
    pick = random.Random(9)
    parts = ["password", "PassWord", "token", "api_key", "ApiKey", "=", ": ", "'", '"', " ", "AKIA", "akia", "abcdef0123456789",
             "hunter2hunter2", "ABCDEF0123456789", "secret", "passwd", "é", "İ", "K", "ſecret", "🎉", "=x", "\n", "tokentoken=", "0f"]
    scanner = secrets.Scanner()
    for _ in range(5000):
        text = "".join(pick.choices(parts, k=pick.randint(0, 14)))
        assert [s for s in scanner.spans(text) if s[0] in secrets.BASE_KINDS] == plain_spans(text), text


def test_checksums():
    body = "abcdefghijKLMNOPQRST0123456789"
    good = "ghp_" + body + secrets.base62_crc(body)
    bad = good[:-1] + ("A" if good[-1] != "A" else "B")
    scanner = secrets.Scanner()
    assert ("forge", 3, 3 + len(good)) in scanner.spans(f"é, {good} and {bad}") and not scanner.spans(bad)
    assert zlib.crc32(b"") == 0 and secrets.base62_crc("") == "000000"
    assert scanner.spans("card: 4111 1111 1111 1111")[0][0] == "card" and not scanner.spans("card: 4111 1111 1111 1112")


def test_secret_digests(messy, empty):
    got = secrets.span_digests(secrets.scan_secrets(messy)).collect()
    want = []
    for r in messy.select("doc_id", "text").collect():
        base = plain_spans(r.text or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.append((r.doc_id, *(sum(s[0] == k for s in base) for k in secrets.BASE_KINDS), hashlib.sha256(line.encode()).hexdigest(), line))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert secrets.scan_secrets(empty).collect() == []


def plain_winnow(text, k, w):
    points = [ord(c) for c in text]
    if not points:
        return []
    k = min(k, len(points))
    hashes = [int(winnow._gram_hashes(np.array(points[i:i + k], "<u4"), k)[0]) for i in range(len(points) - k + 1)]
    w, chosen = min(w, len(hashes)), set()
    for i in range(len(hashes) - w + 1):
        window = hashes[i:i + w]
        chosen.add(i + max(j for j in range(w) if window[j] == min(window)))
    return [(hashes[i], i) for i in sorted(chosen)]


def polynomial(points, k):
    """The hash of one k-gram, digit by digit."""
    total = 0
    for p in points:
        total = (total * winnow._BASE + p + 1) % (1 << 64)
    x = total
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ (x >> 33)) * factor) % (1 << 64)
    return x >> 32


@pytest.mark.parametrize("k, w", [(1, 1), (3, 4), (5, 7), (8, 3), (24, 48)])
def test_winnow(monkeypatch, k, w):
    pick = random.Random(k)
    texts = ["", "a", "ab", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "🎉é" * 30] + ["".join(pick.choices("abc ", k=pick.randint(0, 200))) for _ in range(60)]
    for block in (1 << 20, 16):
        monkeypatch.setattr(winnow, "_BLOCK", block)
        for text in texts:
            hashes, at = winnow.winnow(text, k, w)
            assert list(zip(hashes.tolist(), at.tolist())) == plain_winnow(text, k, w)
    text = "".join(pick.choices("abc ", k=k + 20))
    assert winnow._gram_hashes(np.array([ord(c) for c in text], "<u4"), k).tolist() == [polynomial([ord(c) for c in text[i:i + k]], k) for i in range(21)]


def test_shared_passages_are_found():
    pick = random.Random(2)
    passage = "".join(pick.choices("abcdefgh ", k=winnow.W + winnow.K - 1))
    a, b = ("".join(pick.choices("abcdefgh ", k=400)) for _ in range(2))
    assert set(winnow.winnow(a + passage)[0]) & set(winnow.winnow(passage + b)[0])


def plain_edits(rows):
    def order(r):
        return (r.doc_id is not None, r.doc_id or 0)

    rows = sorted(rows, key=order)
    out = []
    for i, r in enumerate(rows):
        text, after = r.text or "", rows[(i + 1) % len(rows)].text or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        marks = [winnow.winnow(t) for t in (text, edited, after)]
        out.append((r.doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), winnow._as_text(*marks[0]), winnow._as_text(*marks[1]),
                    round(winnow.likeness(marks[0][0], marks[1][0]), 9), round(winnow.likeness(marks[0][0], marks[2][0]), 9)))
    return out


@pytest.mark.parametrize("chunk_chars", [200, 3000, 1 << 22])
def test_edits(varied, chunk_chars):
    got = winnow.edit_fingerprints(varied.repartition(6), chunk_chars=chunk_chars).collect()
    assert sorted((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got) == sorted(plain_edits(varied.collect()))


def test_edits_of_busy_ids(spark):
    """A third of the rows have one id, a third none: they are cut by text hash, in the order of one chunk."""
    big = (1 << 60) + 1
    docs = spark.range(900).selectExpr(f"CASE WHEN id % 3 = 0 THEN {big}L WHEN id % 3 = 2 THEN {big - 450_000}L + id * 1000 END AS doc_id",
                                       "concat('text number ', id * 7919 % 1000, ' ', id) AS text")
    rows = docs.selectExpr("doc_id", "text", "xxhash64(text) AS mark")
    chunked = winnow._chunked(rows, 400).collect()
    order = sorted(chunked, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.mark))
    assert [r.chunk for r in order] == sorted(r.chunk for r in chunked)
    sizes = Counter(r.chunk for r in chunked)
    assert len(sizes) > 30 and max(sizes.values()) < 70
    assert sorted(map(str, winnow.edit_fingerprints(docs, chunk_chars=400).collect())) == sorted(map(str, winnow.edit_fingerprints(docs).collect()))


def test_edits_of_messy_rows(messy, empty, spark):
    for chunk_chars in (10, 1 << 22):
        got = winnow.edit_fingerprints(messy, chunk_chars=chunk_chars).collect()
        assert sorted(str((r.doc_id, r.n_chars)) for r in got) == sorted(str((r.doc_id, len(r.text or ""))) for r in messy.select("doc_id", "text").collect())
    assert winnow.edit_fingerprints(empty).collect() == []
    one = winnow.edit_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert sorted(r.fingerprint for r in winnow.document_fingerprints(messy).collect())[0] == ""


def test_short_texts_keep_their_likeness():
    """A text and its edit share a fingerprint wherever half of the text is as long as the guarantee; likeness is near that of all k-grams."""
    pick = random.Random(7)

    def grams(text, k):
        return {text[i:i + k] for i in range(max(1, len(text) - k + 1))}

    missed, far = [], []
    for n in range(20, 151):
        for _ in range(8):
            text, after = ("".join(pick.choices("abcdefghijklmnop ", k=n)) for _ in range(2))
            edited = text[:n - n // 2] + after[:n // 2]
            got = winnow.likeness(winnow.winnow(text)[0], winnow.winnow(edited)[0])
            a, b = grams(text, winnow.K), grams(edited, winnow.K)
            want = len(a & b) / len(a | b)
            missed += [n] if got == 0 < want else []
            far.append(abs(got - want))
    assert max(missed, default=0) < 2 * (winnow.W + winnow.K - 1) - 1 < 30
    assert sum(far) / len(far) < 0.06


def test_fingerprint_text():
    at = np.array([0, 5, 9, 10, 99, 100, 9999, 10000, 123456, 99999999, 100000000, 4294967295], np.uint64)
    hashes = np.array([0, 1, 0xFFFFFFFF, 0xABCDEF, 16, 255, 256, 7, 0xDEADBEEF, 3, 4, 5], np.uint64)
    for n in range(len(at) + 1):
        assert winnow._as_text(hashes[:n], at[:n]) == " ".join(f"{h:08x}@{p}" for h, p in zip(hashes[:n].tolist(), at[:n].tolist()))
    assert winnow._as_text(hashes[-3:], at[-3:]) == "00000003@99999999 00000004@100000000 00000005@4294967295"
