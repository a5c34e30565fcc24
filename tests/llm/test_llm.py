"""Brute-force versions, round trips and odd cases of the training-data operators on small tables."""

import base64
import hashlib
import hmac
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import date, timedelta

import duckdb
import numpy as np
import public_tokenizers as vocabularies
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nodecensus.llm import html, minhash, packing, pii, quality, registry, spm, substrings, suffixes, topk, warc

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
PASSAGE = " ".join(f"word{i}" for i in range(60))
ODD = [(1, "x " + PASSAGE + " y"), (2, None), (3, ""), (4, "\n\t "), (5, PASSAGE), (5, PASSAGE), (None, PASSAGE), (6, "a " * 300), (7, "É漢字\U0001f600 <|endoftext|> \x00 don't"), (8, "one two three"), (9, "One TWO three")]


def words(text):
    return [w for w in SPACE.split(text or "") if w]


@pytest.fixture(scope="session")
def rows():
    t = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"]) for r in t]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", None, 1, "k", "r") for d, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, key string, rep string")


def test_ranks():
    rng = random.Random(1)
    for _ in range(200):
        t = np.array([rng.randint(1, 3) for _ in range(rng.randint(0, 50))], np.int64)
        got = suffixes.ranks(t, 10**9)
        assert np.argsort(got, kind="stable").tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def brute_bytes(rows, window=200):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + window] for i in range(len(b) - window + 1))
    out = []
    for d, t in rows:
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_suffixes(docs, rows, odd):
    assert sorted(map(tuple, suffixes.dedup(docs).collect()), key=repr) == brute_bytes(rows)
    assert sorted(map(tuple, suffixes.dedup(odd).collect()), key=repr) == brute_bytes(ODD)
    assert suffixes.dedup(odd.limit(0)).count() == 0


def test_suffixes_by_chance(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 400)))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(map(tuple, suffixes.dedup(df, 40).collect()), key=repr) == brute_bytes(texts, 40)


def test_suffixes_of_patterns(spark):
    """Strings over two letters that polynomial digests can't tell apart."""
    texts = []
    for n in (256, 512):
        x, y = thue_morse(n)
        texts += [(len(texts) + k, t) for k, t in enumerate([x, y, "start " + x, y + " end", x[:128] + "-" + x[128:], x[:180], y[60:]])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for window in (200, 100):
        assert sorted(map(tuple, suffixes.dedup(df, window).collect()), key=repr) == brute_bytes(texts, window)


@pytest.mark.parametrize("many", [2, 10**9])
def test_suffixes_of_a_hot_key(spark, many):
    """One passage in many texts, each in other surroundings: shipped whole and in parts, with equal results."""
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(190))
    word = lambda n: "".join(rng.choice("klmnop ") for _ in range(n))
    ends = [word(30) for _ in range(40)]
    texts = [(i, rng.choice(ends)[rng.randint(0, 20) :] + passage + rng.choice(ends)[: rng.randint(0, 25)] + (word(40) if i % 2 else "")) for i in range(120)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted(map(tuple, suffixes.dedup(df, 200, many).collect()), key=repr)
    assert got == brute_bytes(texts) and any(r[2] for r in got) and not all(r[2] for r in got)


def test_suffixes_deal_a_hot_key():
    """150 bytes that are common to 100,000 segments: the parts' keys spread them over buckets within three times the median."""
    rng = np.random.default_rng(1)
    passage, loads = rng.integers(97, 107, 150).astype(np.uint8).tobytes(), np.zeros(64, np.int64)
    for _ in range(5):  # 20,000 segments each
        texts = [rng.integers(107, 117, 60).astype(np.uint8).tobytes() + passage + rng.integers(107, 117, 60).astype(np.uint8).tobytes() for _ in range(4000)]
        from nodecensus.llm.chunks import pack_texts

        data = pack_texts(list(range(len(texts))), texts)
        q = suffixes.Asked(data, suffixes._aux(200)(data), 200)
        assert len(q.key) >= len(texts)
        for number in range(0, len(q.key), 3):
            for key, _, part in q.parts(number, True):
                loads[(key >> 20) % 64] += len(part)
    assert loads.max() <= 3 * np.median(loads)


def brute_components(rows, percent=85):
    sets = {}
    for d, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_minhash(docs, rows, odd):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()} == brute_components(rows)
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id} == brute_components([r for r in ODD if r[0]])
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_minhash_group(spark):
    """Copies that differ at single words: many links, one component, and a straggler."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for d in range(40):
        w = list(base)
        for k in rng.sample(range(300), d % 6):
            w[k] = f"x{d}.{k}"
        texts.append((d, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()} == brute_components(texts)


def test_minhash_of_patterns(spark):
    """Words that polynomial digests can't tell apart are different shingles."""
    texts = []
    for k, n in enumerate((512, 1024)):
        texts += [(10 * k + d, " ".join([*(f"w{i}" for i in range(10)), z, *(f"w{i}" for i in range(10, 24))])) for d, z in enumerate(thue_morse(n))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()} == brute_components(texts)


def test_minhash_of_long_texts(spark):
    """Pairs over LONG shingles about the threshold: links of 85 % and more are found, others aren't."""
    rng = random.Random(4)
    texts = []
    for k in range(12):
        base = [f"{k}.{i}" for i in range(3000)]
        texts.append((100 * k, " ".join(base)))
        for j, share in enumerate((0.9, 0.86, 0.84, 0.8)):
            w = list(base)
            for i in rng.sample(range(600), round(600 * (1 - share) / (1 + share))):
                w[5 * i] = f"x{j}.{k}.{i}"
            texts.append((100 * k + j + 1, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()} == brute_components(texts)


def test_minhash_from_80(spark):
    """Near-duplicates from 80 % on, and from 85 % by default."""
    base = [f"w{i}" for i in range(204)]
    texts = [(1, " ".join(base)), (2, " ".join([*base[:100], "x", *base[101:]])), (3, " ".join([*base[:50], "x", *base[51:100], "y", *base[101:150], "z", *base[151:180], "v", *base[181:]])), (4, " ".join([*base[:20], "1", *base[21:50], "2", *base[51:80], "3", *base[81:110], "4", *base[111:140], "5", *base[141:]]))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    # Of 200 shingles each changed word replaces five: 195 of 205 (0.95), 180 of 220 (0.82) and 175 of 225 (0.78) are common.
    assert {r.doc_id for r in minhash.keep_one(df, 80).collect()} == {1, 4}
    assert {r.doc_id for r in minhash.keep_one(df).collect()} == {1, 3, 4}
    with pytest.raises(ValueError, match="80 %"):
        minhash.keep_one(df, 79)


def test_topk(spark):
    v = spark.createDataFrame([(0, [1.0, 2.0]), (50, [1.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [-1.0, -3.0]), (5, [0.5, 0.5]), (6, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(v, v.where("vec_id % 50 = 0"), 2).collect()))
    assert got == [(0, 1, 5, 98304), (0, 2, 6, 98304), (50, 1, 0, 65536), (50, 2, 5, 32768)]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_max_score_prunes():
    """Candidates over several steps, few wide dimensions and many narrow ones: exact, with ties, as floats and as large numbers."""
    rng = np.random.default_rng(2)
    for scale in (1, 100_000):
        data = (rng.integers(-9, 10, (5000, 40)) * np.where(np.arange(40) < 4, 100, 1) * scale).astype(np.int64)
        data[1000:1020] = data[0]
        ids = rng.permutation(5000).astype(np.int64)
        queries = np.concatenate([data[:3], data[4990:], rng.integers(-50, 50, (4, 40)) * scale])
        own = np.array([*ids[:3], *ids[4990:], 9001, 9002, 9003, 9004])
        got = topk.max_score(queries, own, ids, data, 5)
        want = [(int(me), int(i), int(s)) for me, q in zip(own, queries, strict=True) for s, i in sorted(((int(x), int(i)) for x, i in zip(data @ q, ids, strict=True) if i != me), key=lambda x: (-x[0], x[1]))[:5]]
        assert got == want
    with pytest.raises(OverflowError):
        topk.max_score(np.full((1, 2), 4 << 30), np.array([1]), np.array([2]), np.full((1, 2), 4 << 30), 5)


def test_topk_moves_no_blocks(spark, monkeypatch):
    """Blocks of queries are read where shards are: no join, no copy of a block for each shard, k rows a query and group of shards."""
    for name, value in (("SHARD", 100), ("BLOCK", 7), ("GROUP", 3)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    data = rng.integers(-3, 4, (1500, 6)) / 256  # many ties
    v = spark.createDataFrame([(int(i), [float(x) for x in row][: 3 + i % 4]) for i, row in enumerate(data)], "vec_id long, embedding array<double>")
    found = topk.top_k(v, v.where("vec_id % 50 = 0"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    q = np.floor(256 * data).astype(np.int64)
    q[np.arange(6)[None, :] >= 3 + np.arange(1500)[:, None] % 4] = 0
    want = {(me, k + 1, i, -s) for me in range(0, 1500, 50) for k, (s, i) in enumerate(sorted(((-int(s), i) for i, s in enumerate(q @ q[me]) if i != me))[:5])}
    assert set(map(tuple, found.collect())) == want


def test_topk_over_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 700)
    rng = np.random.default_rng(3)
    data = rng.integers(-300, 300, (3000, 12)) / 256
    v = spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in enumerate(data)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id % 50 = 0")).collect()}
    q = np.floor(256 * data).astype(np.int64)
    for me in range(0, 3000, 50):
        best = sorted(((-int(s), i) for i, s in enumerate(q @ q[me]) if i != me))[:5]
        assert [got[me, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


def plain_noise(key, *said):
    return int(hmac.new(key.encode(), "|".join(map(str, said)).encode(), "sha256").hexdigest()[:15], 16)


def plain_date(day, key):
    a, b = divmod(day, 4297)
    for i in range(pii.ROUNDS):
        a = (a + plain_noise(key, "date", "a", i, b) % 17) % 17
        b = (b + plain_noise(key, "date", "b", i, a) % 4297) % 4297
    return a * 4297 + b


def plain_ip(ip, key):
    p = list(map(int, ip.split(".")))
    a, b = p[0] * 256 + p[1], p[2] * 256 + p[3]
    for i in range(pii.ROUNDS):
        a, b = b, (a + plain_noise(key, "ip", "", i, b) % 65536) % 65536
    return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"


def plain_radix(s, key, kind, alphabet):
    half = -(-len(s) // 2)
    a, b = list(s[:half]), list(s[half:])
    for i in range(pii.ROUNDS):
        v = 0
        for c in b:
            v = (v * 31 + alphabet.index(c) + 1) % 2147483647
        a, b = b, [alphabet[(alphabet.index(c) + plain_noise(key, kind, k, i, f"{v},{''.join(b)}")) % len(alphabet)] for k, c in enumerate(a)]
    return "".join(a + b)


def plain_spread(shape, symbols, chars):
    it = iter(symbols)
    return "".join(next(it) if c in chars else c for c in shape)


def plain_mail(mail, key):
    local, domain = mail.split("@")
    new = local.lower()
    for alphabet in (pii.LOWER, pii.ACCENTED):
        own = "".join(c for c in new if c in alphabet)
        new = plain_spread(new, plain_radix(own, key, "email", alphabet) if own else "", alphabet)
    digits = "".join(c for c in new if c.isdigit())
    assert len(digits) <= 1
    moved = "".join(str((int(d) + plain_noise(key, "email", "0", 0, 0) % 10) % 10) for d in digits)
    new = plain_spread(new, moved, "0123456789")
    return "".join(n.upper() if c != c.lower() else n for c, n in zip(local, new, strict=True)) + "@" + domain


def test_pii_against_plain_networks(spark):
    """Dates (three formats), SSNs, IPs, mails, secrets, phones and IBANs against networks written in plain Python."""
    rng, day0 = random.Random(6), date(1900, 1, 1)
    texts, want = [], []

    def add(text, to):
        texts.append(text)
        want.append(to)

    def walk(x, step, valid):
        x = step(x)
        while not valid(x):
            x = step(x)
        return x

    for _ in range(60):
        n = rng.randrange(73049)
        d, to = day0 + timedelta(n), day0 + timedelta(plain_date(n, "k"))
        add(d.isoformat(), to.isoformat())
        add(f"{d:%d.%m.%Y}", f"{to:%d.%m.%Y}")
        if d.day > 12:
            m = day0 + timedelta(walk(n, lambda x: plain_date(x, "k"), lambda x: (day0 + timedelta(x)).day > 12))
            add(f"{d:%m/%d/%Y}", f"{m:%m/%d/%Y}")
        ok = lambda s: not re.search("^(000|666|9..)|^...00|0000$", s)
        s = walk("", lambda _: f"{rng.randrange(10**9):09}", ok)
        t = walk(s, lambda x: plain_feistel(x, "k", "ssn"), ok)
        add(f"{s[:3]}-{s[3:5]}-{s[5:]}", f"{t[:3]}-{t[3:5]}-{t[5:]}")
        ip = ".".join(str(rng.randrange(256)) for _ in range(4))
        add(ip, plain_ip(ip, "k"))
        mail = "".join(rng.choice("abcXYZéÀ._") for _ in range(rng.randint(1, 9))).strip("._") or "q"
        add(f"{mail}{rng.choice(['', '7'])}@host.example", None)
        want[-1] = plain_mail(texts[-1], "k")
        token = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        add(token, plain_radix(token, "k", "secret", "0123456789abcdef"))
        phone = f"{rng.randrange(200, 999)}5551234"
        p = plain_feistel(phone, "k", "phone")
        add(f"({phone[:3]}) {phone[3:6]}-{phone[6:]}", f"({p[:3]}) {p[3:6]}-{p[6:]}")
        bban = f"{rng.randrange(10**16):016}{rng.randrange(100):02}"
        add(f"DE{98 - int(bban + '131400') % 97:02}{bban}", None)
    rows = pii.pseudonymise(spark.createDataFrame([*enumerate(texts)], "doc_id int, text string"), "k").collect()
    got = {r.doc_id: r.text for r in rows}
    for k, (text, to) in enumerate(zip(texts, want, strict=True)):
        if to is None:
            assert got[k][:2] == "DE" and int(got[k][4:] + "1314" + got[k][2:4]) % 97 == 1 and len(got[k]) == len(text)
        else:
            assert got[k] == to, text
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id int, text string, pii string"), "k").count() == 0


def plain_feistel(digits, key, kind):
    n, u = len(digits), len(digits) // 2
    a, b, p, q = int(digits[:u]), int(digits[u:]), 10**u, 10 ** (n - u)
    for i in range(pii.ROUNDS):
        noise = plain_noise(key, kind, f"{n}.", i, b)
        a, b, p, q = b, (a + noise % p) % p, q, p
    return str(a).zfill(u) + str(b).zfill(n - u)


def test_pii(spark):
    texts = ["card 4539 1488 0343 6467, 4539148803436467.", "2123465659789240", "+1 (743) 555-3824", "70.23.22.57 999.1.1.1", "1984-02-29 29/02/1984 31.02.2001", "hein.19@mail5.example.com", "123-45-6789 000-12-3456", "DE89370400440532013000", None, "", "Version 2.0. is 12345"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    a, b = re.findall(r"\d[\d ]{14,}\d", got[0].text)
    assert a.replace(" ", "") == b != "4539148803436467"
    assert b[:-1] == plain_feistel("453914880343646", "k", "card")
    digits = [int(x) for x in b[::-1]]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert [got[k].text for k in (1, 8, 9, 10)] == [texts[1], None, "", texts[10]]
    assert got[2].text != texts[2] and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[2].text)
    assert got[3].text.endswith(" 999.1.1.1") and not got[3].text.startswith("70.")
    iso, day, bad = got[4].text.split()
    assert bad == "31.02.2001" and iso.split("-") == day.split("/")[::-1] and iso != "1984-02-29"
    assert got[5].text.endswith("@mail5.example.com") and got[5].text != texts[5]
    assert got[6].text.endswith(" 000-12-3456") and "123-45-6789" not in got[6].text
    iban = got[7].text
    assert iban != texts[7] and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_pii_beside_other_tokens(spark):
    """Valid cards, IBANs and secrets whose neighbours could be read as a part of them."""
    texts = ["4111 1111 1111 1111 12/25", "4111111111111111 123", "4111-1111-1111-1111-123", "123 4111111111111111", "1234567 4111 1111 1111 1111", "4222222222222 4111 1111 1111 1111", "4111 1111 1111 1111 12/03/2024",
             "ES91 2100 0418 4502 0005 1332 EUR", "IBAN ES9121000418450200051332 2024", "AT61 1904 3002 3457 3201 BIC", "BE68 5390 0754 7034 0001", "PL61109010140000071219812874 PLN", "SE45 5000 0000 0583 9825 7466 SEK"]
    token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    df = spark.createDataFrame([*enumerate(texts), (50, f"TOKEN={token.upper()} {token}"), (51, "4111 1111 1111 1112 12/25, ES91 2100 0418 4502 0005 1333 EUR")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    alone = {r.text: r.to for r in pii.pseudonymise(spark.createDataFrame([(x, x) for x in ("4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111", "4222222222222", "ES91 2100 0418 4502 0005 1332")], "to string, text string"), "k").select(F.col("to").alias("text"), F.col("text").alias("to")).collect()}
    assert all(a != b for a, b in alone.items())
    one = alone["4111 1111 1111 1111"]
    assert [got[k].text for k in range(6)] == [f"{one} 12/25", f"{alone['4111111111111111']} 123", f"{alone['4111-1111-1111-1111']}-123", f"123 {alone['4111111111111111']}", f"1234567 {one}", f"{alone['4222222222222']} {one}"]
    assert got[6].text.startswith(one) and "12/03/2024" not in got[6].text
    assert got[7].text == alone["ES91 2100 0418 4502 0005 1332"] + " EUR"
    assert all(got[k].pii["iban"] == 1 and got[k].text[-3:] == texts[k][-3:] and got[k].text != texts[k] for k in range(7, 13))
    upper, lower = got[50].text.removeprefix("TOKEN=").split()
    assert upper == lower.upper() and lower != token and got[50].pii["secret"] == 2
    assert got[51].text == "4111 1111 1111 1112 12/25, ES91 2100 0418 4502 0005 1333 EUR"


def test_feistel_is_a_permutation(spark):
    got = [r[0] for r in spark.range(1000).select(pii.feistel_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "x")).collect()]
    assert len(set(got)) == 1000 and all(len(x) == 3 for x in got)


def test_html(spark):
    page = '<html><body><nav><a>menu</a></nav><div class="ad">buy</div><article><h1>T&amp;x</h1><p>One  two<br>three<p>four <b>five<script>x="</p>"</script></article><div id="comments">no</div><footer>f</footer>'
    open_ = '<body><div class="top">Site name</div><div class="wrap"><p>Unique {0} text</p></div></body>'
    df = spark.createDataFrame([(1, "http://a/1", page), (2, None, None), (3, "http://c/1", "")] + [(10 + i, f"http://b/{i}", open_.format(i)) for i in range(5)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert got[1].text == "T&x One two three four five" and got[1].n_chars == 27
    assert (got[2].text, got[3].text) == ("", "")
    assert got[12].text == "Unique 2 text"


def test_html_boxes_in_articles(spark):
    """What a host repeats in its articles is cut; copies of a page, and articles alike but for a line, keep their text."""
    body = "".join(f"<p>Paragraph {k} of a text.</p>" for k in range(9))
    box = '<div class="author-box"><p>Written by the staff of this site.</p></div>'
    page = "<body><p class=top>Site</p><article><h1>News</h1><div class=c><p>Text {0} is its own.</p></div>{1}</article>"
    df = spark.createDataFrame([(i, f"http://a/{i}", page.format(i, box)) for i in range(6)] + [(10 + i, f"http://b/{i}", page.format(0, box)) for i in range(6)] + [(20 + i, f"http://c/{i}", f"<article><p class=date>Day {i}</p><div class=c>{body}</div></article>") for i in range(6)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert [got[i] for i in range(6)] == [f"News Text {i} is its own." for i in range(6)]
    assert {got[10 + i] for i in range(6)} == {"News Text 0 is its own. Written by the staff of this site."}
    assert all(got[20 + i].startswith(f"Day {i} Paragraph 0") and got[20 + i].endswith("8 of a text.") for i in range(6))


def test_html_anchors_in_articles(spark):
    """Words of noise within ids and classes of an article's own parts; whole values are noise still."""
    own = '<h2 id="related-work">One</h2><section id="discussion"><p>two</p></section><div id="search-algorithms">three</div><p id="notice-period">four</p><div class="content hidden-print">five</div><p class="searchWord">six</p>'
    noise = '<div class="x related">no</div><div id="comments">no</div><section class="share">no</section><p role="search">no</p><nav id="n">no</nav>'
    df = spark.createDataFrame([(1, "http://a/1", f"<body><div id=site-search>no</div><article>{own}{noise}</article>")], "page_id long, url string, html string")
    assert html.extract(df).first().text == "One two three four five six"


def test_html_names_are_hints(spark):
    """Names that only hold a word of noise don't drop the story; headlines in an article's header and buttons in sentences stay."""
    pages = {
        1: '<div class="layout has-sidebar"><p>The story of this page is long enough.</p></div><div class="left-sidebar">Links</div>',
        2: '<main><div class="comment-free search-result">Found this.</div><div class="comments">Reader</div></main>',
        3: "<header>Site</header><article><header><h1>Head</h1></header><p>Press <button>OK</button> now.</p><div><button>Share</button></div></article>",
        4: '<form id="aspnetForm"><p>lost, as forms are</p></form><div class="search-algorithms"><h1>A</h1></div><p>' + "b " * 99 + "</p>",
    }
    df = spark.createDataFrame([(k, f"http://h{k}/", h) for k, h in pages.items()], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert [got[1], got[2], got[3]] == ["The story of this page is long enough.", "Found this.", "Head Press OK now."]
    assert got[4] == "A " + ("b " * 99).strip()


def brute_tree(pages):
    """Composite importance by (path) of one host's pages, each a nested (mark, [child or text]) element."""
    from math import log

    nodes, contents = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))

    def visit(page, path, element):
        mark, below = element
        path = f"{path}/{mark}"
        nodes[path][tuple("" if isinstance(x, str) else x[0] for x in below)].add(page)
        for x in below:
            if isinstance(x, str):
                contents[path][x].add(page)
            else:
                visit(page, path, x)

    for k, root in enumerate(pages):
        visit(k, "", root)

    def importance(path):
        styles = nodes[path]
        m = len(set().union(*styles.values()))
        content = 1 - sum(min(1, log(len(x)) / log(m + html.PRIOR)) for x in contents[path].values()) / len(contents[path]) if path in contents else 0
        if not any(x for s in styles for x in s):
            return content
        total = sum(map(len, styles.values()))
        shown = 1 if m == 1 else min(1, -sum(len(x) / total * log(len(x) / total) for x in styles.values()) / log(m + html.PRIOR))
        below = sum(len(p) / total * sum(content if c == "" else importance(f"{path}/{c}") for c in set(s)) / len(set(s)) for s, p in styles.items() if s)
        return (1 - html.GAMMA ** len(styles)) * shown + html.GAMMA ** len(styles) * below

    return {p: importance(p) for p in nodes}


def test_html_tree(spark):
    """Composite importance against a tree written out, over random pages of one host (and a copy, which counts for nothing)."""
    import xxhash

    rng = random.Random(9)

    def element(depth):
        mark = rng.choice(["div", "div.a", "p", "section"]) if depth < 3 else "p"
        if mark == "p" or depth == 4:
            return ("p", [rng.choice(["same", "also", f"own {rng.random()}"])])
        below = [element(depth + 1) for _ in range(rng.randint(1, 3))]
        return (mark, [f"text {rng.randint(0, 2)}", *below] if rng.random() < 0.3 else below)

    def markup(x):
        if isinstance(x, str):
            return x
        tag, _, cls = x[0].partition(".")
        return f"<{tag}{f' class={cls}' if cls else ''}>{''.join(map(markup, x[1]))}</{tag}>"

    pages = [("html", [("body", [element(1) for _ in range(rng.randint(1, 4))])]) for _ in range(12)]
    df = spark.createDataFrame([(k, "http://a/x", markup(x)) for k, x in enumerate([*pages, pages[0]])], "page_id long, url string, html string")
    got = {r.path: r.importance for r in html.style_tree(html.parse(df).cache()).collect()}
    want = {xxhash.xxh3_64_intdigest(p) - (1 << 63): v for p, v in brute_tree(pages).items()}
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_html_articles(spark):
    pages = {r["page_id"]: r["html"] for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    from html import unescape

    for r in html.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(unescape(re.sub(r"<[^>]+>", " ", article)).split())


def test_sentencepiece(docs, odd):
    import sentencepiece

    path = vocabularies.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (docs, odd):
        for r in df.select("doc_id", "text").join(spm.encode(df, path).dropDuplicates(["doc_id"]), "doc_id").collect():
            assert list(r.ids) == lib.encode(r.text or "")
            assert r.decoded == lib.decode(list(r.ids))


def test_packing(docs, odd):
    from tokenizers import Tokenizer

    path = vocabularies.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got, pieces = packing.pack(docs.union(odd.select(docs.columns).where("doc_id in (2, 3, 6, 7, 8)").withColumn("doc_id", F.col("doc_id") + 1_000_000)), path).collect(), defaultdict(list)
    texts = dict(docs.select("doc_id", "text").collect()) | {d + 1_000_000: t for d, t in ODD if d in (2, 3, 6, 7, 8)}
    for r in got:
        pieces[r.doc_id].append(r)
    assert pieces.keys() == texts.keys()
    assert len({r.sequence_id for r in got}) == len(got)
    for d, text in texts.items():
        ids, at = lib.encode(text or "", add_special_tokens=False).ids + [0], 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.offset) == (at, len(ids), 0) and r.length in {1 << k for k in range(11)}
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_of_odd_texts(spark):
    """White space of all kinds, alone and about letters; long runs; special tokens' strings; and ``with_ids``."""
    from tokenizers import Tokenizer

    path, rng = vocabularies.path("byte_bpe_50k.json"), random.Random(8)
    lib = Tokenizer.from_file(path)
    texts = ["\u00a0", "\u3000", "\r", "\u00a0\r\n\u3000", " " * 5000, " " * 5000 + "x", "\n \u2028" * 3000, "a<|endoftext|> b", "'s 'S don't", "\x00\x1c\x85", "ab" * 3000]
    texts += ["".join(rng.choice([" ", " ", "\u00a0", "\u3000", "\n", "\r", "\t", "a", "B", "é", "1", "."]) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id int, text string")
    got = defaultdict(list)
    for r in packing.pack(df, path, 64, with_ids=True).collect():
        got[r.doc_id].append(r)
    for d, text in enumerate(texts):
        assert [i for r in sorted(got[d], key=lambda r: r.start) for i in r.ids] == lib.encode(text, add_special_tokens=False).ids + [0]
    assert packing.pack(df.limit(0), path).count() == 0


def test_warc(spark):
    df = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "a\nb", "x" * 300000), (2, "a\nb", "x" * 300000), (3, "c", "é" * 3)], "page_id long, url string, html string")
    got = sorted((tuple(r) for r in warc.read_archives(warc.archive(df)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    x = "x" * 300000
    assert got == sorted([(1, 0, sha(""), "response", None), (None, 0, sha(""), "revisit", 1), (2, 300000, sha(x), "response", None), (2, 300000, sha(x), "revisit", 2), (3, 6, sha("ééé"), "response", None)], key=repr)
    assert warc.read_archives(warc.archive(df.limit(0))).count() == 0
    many = spark.range(300, numPartitions=7).selectExpr("300 - id AS page_id", "cast(null as string) AS url", "repeat(concat('p', id % 40, ' '), 20000) AS html", "'x' AS data")
    back = {r.page_id: r for r in warc.read_archives(warc.archive(many)).collect()}
    assert len(back) == 300
    for i in range(300):
        least = min(300 - k for k in range(i % 40, 300, 40))
        assert (back[300 - i].record_type, back[300 - i].refers_to) == (("response", None) if 300 - i == least else ("revisit", least))


def test_substrings(odd):
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substrings.dedup(odd, 20, 5).collect()}
    assert got == {(1, 62, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 60, 60), (None, 60, 60), (6, 300, 299), (7, 4, 0), (8, 3, 0), (9, 3, 0)}
    assert substrings.dedup(odd.limit(0)).count() == 0


def thue_morse(n, a="a", b="b"):
    """Two words of n letters, n a power of two, that are made of the same letters in complementary patterns."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


@pytest.mark.parametrize("n", [512, 1024])
def test_substrings_of_patterns(spark, n):
    """Words, and sequences of words, that polynomial digests can't tell apart."""
    x, y = thue_morse(n)
    texts = [(d, " ".join([*(f"w{i}" for i in range(10)), z, *(f"w{i}" for i in range(10, 24))])) for d, z in enumerate((x, y))]
    texts += [(2 + d, " ".join(z.replace("a", "one ").replace("b", "two ").split() + [f"end{d}"])) for d, z in enumerate(thue_morse(n))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for window in (20, 200):
        assert {r.doc_id: r.n_removed for r in substrings.dedup(df, window, 5).collect()} == brute_words(texts, window)


def brute_words(rows, window):
    """Words removed of each document (doc_ids are distinct)."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        w, gone = words(t), set()
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if x in seen:
                gone |= set(range(i, i + window))
            seen.add(x)
        out[d] = len(gone)
    return out


@pytest.mark.parametrize("base", [1, 3, 5, 10])
def test_substrings_from_any_base(spark, base):
    rng = random.Random(base)
    texts = [(d, " ".join(rng.choice("abc") if rng.random() < 0.9 else f"u{rng.randint(0, 99)}" for _ in range(rng.randint(0, 150)))) for d in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.dedup(df, 12, base).collect()} == brute_words(texts, 12)
    unique = spark.createDataFrame([(1, " ".join(map(str, range(90)))), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, substrings.dedup(unique, 12, base).select("doc_id", "n_words", "n_removed").collect())) == [(1, 90, 0), (2, 0, 0)]


def test_substrings_documents(spark):
    """Different texts under a null and under an equal doc_id: each keeps its own."""
    one, two = ("".join(f"{p}{i} " for i in range(30)).strip() for p in "ab")
    texts = [(1, one), (None, "own start " + one), (None, "another text"), (None, None), (None, "own start " + one), (7, "x " + one), (7, "y " + two), (7, "z"), (9, two + " end")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted(map(tuple, substrings.dedup_documents(df).collect()), key=repr)
    assert got == sorted([(1, one), (None, "own start"), (None, "another text"), (None, None), (None, "own start"), (7, "x"), (7, "y " + two), (7, "z"), (9, "end")], key=repr)


def test_quality(odd):
    got = {r.doc_id: r for r in quality.score(odd).collect()}
    assert (got[2].n_words, got[2].base_failed, got[2].kept) == (0, True, False)
    assert (got[6].n_words, got[6].n_repeat_words, got[6].base_failed) == (300, 300, True)
    assert got[5].kept and got[1].kept
    assert quality.filter_documents(odd).columns == odd.columns


def test_quality_by_source(spark):
    """Sources whose documents differ in spread get limits of their own, and equal documents are judged by them."""
    rng = random.Random(3)
    plain = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 6))) for _ in range(60))
    noisy = lambda k: plain() + " " + " ".join(["#" * 4] * k)
    rows = [(i, plain(), "en", "a") for i in range(1000)] + [(1000 + i, noisy(rng.randint(0, 9)), "en", "b") for i in range(1000)] + [(2000, noisy(4), "en", "a"), (2001, noisy(4), "en", "b")]
    rows += [(3000, None, None, None), (3001, "", "en", "a"), (3002, plain(), None, None), (3003, plain(), "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.score(df).collect()}
    assert (got[2000], got[2001], got[3000], got[3001]) == (False, True, False, False)
    assert sum(got[i] for i in range(1000)) >= 930 and sum(got[i] for i in range(1000, 2000)) >= 930
    edges = {r.source: r.max_symbols for r in quality.limits(quality.measured(df).where("not _quality.base_failed").select("lang", "source", *(F.col(f"_quality.{k}").alias(k) for k in quality.LEVELS))).where("lang = 'en'").collect()}
    assert edges["a"] < edges[None] < edges["b"]
    assert quality.score(df.limit(0)).count() == 0 and quality.filter_documents(df.limit(0)).count() == 0


def test_pipeline(spark, docs):
    """Each stage against what it should keep, then the whole."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "pii", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, SF)
    good = {r.doc_id for r in quality.score(docs).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == docs.columns
    one = stages["near_dedup"](spark, kept, SF)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert {r.doc_id for r in one.collect()} == {d for d, (_, c) in brute_components(rows, 80).items() if c == d}
    less = stages["substring_dedup"](spark, one, SF)
    assert less.columns == docs.columns and less.count() == one.count()
    final = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in final} == {r.doc_id for r in one.collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    said = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in said.description]
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(said.fetchall(), key=repr)
