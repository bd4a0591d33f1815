"""Secrets, personal data, media and token counts against plain forms."""

import hashlib
import math
import random
import re
import struct
import time
import zlib

import pytest

from paramscan.llm import media_sniff, pii, secret_dfa, token_counts

ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_secrets(t):
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    for n, (p, least) in enumerate((("AKIA[A-Z0-9]+", 20), ("[0-9a-f]+", 24)), 1):
        out += [(m.start(), m.end(), n) for m in re.finditer(p, t) if m.end() - m.start() >= least]
    return sorted(out, key=lambda x: (x[0], x[2]))


def secret_texts(count):
    rng = random.Random(1)
    parts = ["password", "passwd", "Secret", "toKen", "api_key", "apikey", "API_KEY", " ", "  ", ":", "=", '"', "'", "abc", "secret=", "é", "AKIA", "A1B2C3", "0123456789abcdef", "deadbeef", "Z", "x", ".", "-", "_", "abcdef0123", "\n", "😀"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(count)]


def test_secret_spans_equal_regexes():
    auto = secret_dfa.compile_rules()
    for t in [*secret_texts(8000), "", "f" * 100000, "secret=" * 5000]:
        assert [x for x in secret_dfa.find_secrets(t, auto) if x[2] < 3] == plain_secrets(t)


def test_secrets_in_very_long_and_repeated_texts(spark):
    auto = secret_dfa.compile_rules()
    long = "é token=abcdef " * 40_000 + "x" * 500_000 + " AKIA" + "A1" * 20
    assert [x for x in secret_dfa.find_secrets(long, auto) if x[2] < 3] == plain_secrets(long)
    df = spark.createDataFrame([(1, long[:2000]), (1, long[:2000]), (None, "secret=abcdef"), (2, None)], "doc_id long, text string")
    rows = sorted(map(tuple, secret_dfa.report(df).select("doc_id", "n_assign").collect()), key=repr)
    assert rows == sorted([(1, len(plain_secrets(long[:2000])))] * 2 + [(None, 1), (2, 0)], key=repr)


def test_added_secret_kinds():
    auto = secret_dfa.compile_rules()
    t = "ghp_" + "a1B2" * 9 + " -----BEGIN RSA PRIVATE KEY----- xoxb-123456789012-abc eyJabc.eyJdef.sig-x ghp_short"
    assert [secret_dfa.RULES[n].kind for _, _, n in secret_dfa.find_secrets(t, auto)] == ["github", "private_key", "slack", "jwt"]


def test_secret_report_and_redaction(spark):
    texts = [None, "", *secret_texts(60), "é token=abcdef é " * 50]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, secrets int")
    for r in secret_dfa.report(df).collect():
        found = plain_secrets(texts[r.doc_id] or "")
        joined = ",".join(f"{('assign', 'access', 'hex')[n]}:{a}:{b}" for a, b, n in found)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(1 for x in found if x[2] == n) for n in range(3))
    auto = secret_dfa.compile_rules()
    masked = {r.doc_id: r.text for r in secret_dfa.redact(df).collect()}
    assert masked[0] is None and masked[1] == "" and "[assign]" in masked[len(texts) - 1]
    assert all(not [x for x in secret_dfa.find_secrets(t, auto) if x[2] in (1, 2)] for t in masked.values())
    assert secret_dfa.report(df.limit(0)).count() == 0


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_pii(t):
    out = []
    for k, (name, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[name]
            if good:
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_pii_equals_regexes(spark):
    rng = random.Random(3)
    parts = ["a@b.co", ".c@d.e", "x.y", "@", "1.2.3.4", ".", "-", " ", "+", "+49 (30) 123-456", "4111 1111 1111 1111", "4111111111111111", "12", "7", "255", "999", "0", "é", "😀", "email ", "_", "%", "(", ")", "\n"]
    texts = [None, "", *["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(1500)], "1.2.3.4 " * 400, "9" * 20000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii string").repartition(8)
    for r in pii.report(df).collect():
        assert r.base_sha256 == hashlib.sha256(plain_pii(texts[r.doc_id]).encode()).hexdigest(), texts[r.doc_id]
    assert pii.report(df.limit(0)).count() == 0


def test_pii_keeps_clashing_columns(spark):
    names = ["__m_email", "matches of email", "matches of email_", "Pieces of IP", "kept of ssn", "m"]
    df = spark.createDataFrame([(1, "a@b.co 1.2.3.4", *"qrstuv")], ["doc_id", "text", *names])
    got = pii.with_pii(df)
    assert got.columns == [*df.columns, "pii"] and tuple(got.first())[:8] == tuple(df.first()) and len(got.first().pii) == 2
    again = pii.with_pii(got.withColumn("pii", pii.F.lit("old")))
    assert again.columns == got.columns and tuple(again.first()) == tuple(got.first())


def test_pii_added_kinds_and_context(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 01", "ssn 123-45-6789", "number 123-45-6789", "write to a@b.co", "x a@b.co"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert [got[i].n_iban for i in (0, 1)] == [1, 0] and [got[i].n_ssn for i in (2, 3)] == [1, 0]
    assert got[4].top_score > got[5].top_score > 0


def png(width=2):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (width + 1))) + chunk(b"IEND", b"")


def samples():
    import gzip
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.txt", "hello")
    gif = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
    jpeg = b"\xff\xd8\xff\xe0\0\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0\xff\xda\0\x08\x01\x01\0\0?\0\x12\xff\0\x34\xff\xd9"
    return {"image/png": png(), "application/gzip": gzip.compress(b"x" * 1000), "application/zip": held.getvalue(), "image/gif": gif, "image/bmp": bmp, "image/jpeg": jpeg, "audio/wav": media_sniff.to_wav(b"a" * 192), "application/pdf": b"%PDF-1.4\nstartxref\n0\n%%EOF"}


@pytest.mark.parametrize("kind", sorted(samples()))
def test_sniffs_corrects_and_carves(kind):
    data = samples()[kind]
    found = media_sniff.sniff(data)
    assert (found[0].type, found[0].start, found[0].end) == (kind, 0, len(data))
    assert media_sniff.corrected("text/plain", found) == kind
    inside = b"junk BM RIFF GIF89a PK\x03\x04" + data + b"tail"
    assert data in media_sniff.carved(inside, media_sniff.sniff(inside))
    assert not [f for f in media_sniff.sniff(data[: len(data) // 2]) if f.start == 0]


def hostile(n):
    """Values of about ``n`` bytes in which many magics lead through one structure."""
    head = b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR" + b"\0" * 13
    head += struct.pack(">I", zlib.crc32(head[12:]))
    yield b"".join(head + struct.pack(">I4s", 45 * max(0, n // 45 - i - 1) - 4 if i < n // 45 - 1 else 0, b"IDAT") + b"abcd" for i in range(n // 45))
    yield (b"PK\3\4" + b"\0" * 26 + b"x") * (n // 31)
    yield (b"PK\3\4PK\5\6" + b"\0" * 20) * (n // 28)
    yield (b"OggS\0\0" + b"\0" * 21) * (n // 27)
    yield b"%PDF-1.4 " * (n // 9)
    yield b"%PDF-1.4 " * (n // 18) + b"%%EOF " * (n // 18) + b"startxref"
    yield (b"GIF89a\1\0\1\0\0\0\0," + b"\0" * 9 + b"\2\1a") * (n // 26)
    yield b"".join(b"RIFF" + struct.pack("<I", n - 20 * i) + b"WAVERIFF\0\0\0\0" for i in range(n // 20))
    yield (b"RIFF\4\0\0\0WAVE") * (n // 24) + b"data\0\0\0\0" * (n // 16)
    yield b"\xff\xd8\xff\xe0\0\4ab" * (n // 8)
    yield b"\xff\xd8\xff\xda\xff\xf0" * (n // 12) + b"\xff\0" * (n // 4)
    yield b"BM" * (n // 2)


def test_hostile_values_take_time_in_proportion():
    for number, data in enumerate(hostile(1_000_000)):
        began = time.process_time()
        media_sniff.sniff(data)
        assert time.process_time() - began < 15, number


def test_check_sums_of_parts():
    rng = random.Random(2)
    data = rng.randbytes(700_000)
    value = media_sniff.Value(data)
    for _ in range(30):
        a, b = sorted(rng.randrange(len(data) + 1) for _ in range(2))
        assert value.crc(a, b) == zlib.crc32(data[a:b])


def riff(form, chunks):
    body = form + b"".join(kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1) for kind, data in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_chunks_of_nested_audio():
    rng = random.Random(7)
    for _ in range(300):
        inner, want = b"", []
        for _ in range(rng.randrange(1, 5)):
            chunks = [(rng.choice([b"fmt ", b"data", b"JUNK"]), rng.choice([b"", b"x", b"abcd"])) for _ in range(rng.randrange(20))]
            chunks.insert(rng.randrange(len(chunks) + 1), (b"LIST", inner))
            outer = riff(b"WAVE", chunks)
            at = outer.index(inner) if inner else 0
            if inner:
                want = [(a + at, b + at) for a, b in want]
            if {b"fmt ", b"data"} <= {kind for kind, _ in chunks}:
                want.append((0, len(outer)))
            inner = outer
        found = [(f.start, f.end) for f in media_sniff.sniff(inner)]
        assert found == sorted(want, key=lambda x: (x[0], -x[1]))


def test_media_round_trip(spark):
    texts = [None, "", "é" * 96, "a" * 193, "same", "same", "RIFF\x00WAVE" * 50, "x" * 300000]
    df = spark.createDataFrame([(i, t, b"m") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    rows = {r.doc_id: r for r in media_sniff.report(df).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_type == "audio/wav"
        assert r.media_sha256 == hashlib.sha256(media_sniff.to_wav(payload)).hexdigest()
    assert rows[4].feature == rows[5].feature and media_sniff.report(df.limit(0)).count() == 0
    typed = spark.createDataFrame([(png(), "image/gif"), (b"plain", "text/plain"), (None, "x")], "media binary, said string")
    assert [r.t for r in media_sniff.with_sniffed(typed, declared="said").selectExpr("sniffed.type as t").collect()] == ["image/png", "text/plain", None]


def slow_tokens(word, vocabulary):
    data = word.encode()
    best = [(0.0, 0)] + [(-1e300, 0)] * len(data)
    for end in range(1, len(data) + 1):
        for start in range(end):
            score = vocabulary.get(data[start:end])
            if score is not None and best[start][0] > -1e300:
                total = (best[start][0] + score, -best[start][1] - 1)
                if total > (best[end][0], -best[end][1]):
                    best[end] = (total[0], -total[1])
    return best[-1][1]


def test_token_counts_equal_plain_dynamic_programming(spark):
    import regex

    vocabulary = token_counts.read_vocabulary()
    texts = [None, "", " ", "Hello world's don't 12345 éàü 😀!!  \n x", "a" * 300, "internationalisation " * 5, "internationalise interna", "Hello world's don't 12345 éàü 😀!!  \n x"]
    df = spark.createDataFrame([(i % 7, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, tokens int")
    got = sorted((r.doc_id, r.n_pretokens, r.n_tokens) for r in token_counts.report(df).collect())
    want = []
    for i, t in enumerate(texts):
        words = regex.findall(token_counts.PATTERN, t or "")
        assert "".join(words) == (t or "")
        want.append((i % 7, len(words), sum(slow_tokens(w, vocabulary) for w in words)))
    assert got == sorted(want)
    assert token_counts.report(df.limit(0)).count() == 0
    kept = token_counts.with_token_counts(df)
    assert kept.columns == df.columns and kept.schema["tokens"].dataType == token_counts.RESULT  # ``out`` replaces a column of its name


def test_token_counts_share_prefixes(monkeypatch):
    import regex

    rng = random.Random(4)
    vocabulary = {piece.encode(): -math.log(n + 1) for n, piece in enumerate("a b c ab bc abc ca cab aaaa bbbbbbb cc".split())}
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(300)}
    long = "".join(rng.choice("abc") for _ in range(200))
    words |= {long[:k] + tail for k in range(0, 200, 7) for tail in ("", "a", "bbbbbbb", "cab")}
    words |= {"dab", "abd", "d"}  # a byte of no piece
    texts = [None, "", *(" ".join(sorted(words, key=lambda w: rng.random())) for _ in range(3)), *words]
    pattern = regex.compile(r"\w+")
    want = [(len(pattern.findall(t or "")), sum(slow_tokens(w, vocabulary) for w in pattern.findall(t or ""))) for t in texts]
    for near, kept, batch, piece in ((64, 10**6, 10**6, 10**6), (1, 5, 30, 7), (5, 50, 300, 20)):
        for name, value in (("NEAR", near), ("KEPT", kept), ("BATCH", batch), ("SLICE", piece)):
            monkeypatch.setattr(token_counts, name, value)
        assert token_counts.Counter(vocabulary).count(texts, pattern) == want


@pytest.mark.parametrize("module", [secret_dfa, pii])
def test_reports_equal_sql(spark, tmp_path, module):
    import duckdb

    rng = random.Random(9)
    parts = ["a@b.co", "1.2.3.4", ".", "-", " ", "+", "+49 (30) 123-456", "4111 1111 1111 1111", "12", "7", "0", "email ", "card: ", "\n", "iban DE89 3704 0044 0532 0130 00 ", " ssn 123-45-6789 "]
    texts = [None, "", *(t.replace("é", "e") for t in secret_texts(150)), *["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(150)]]
    path = str(tmp_path / "documents")
    spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    found = db.execute(module.ORACLE)
    names = [d[0] for d in found.description]
    got = [tuple(r) for r in module.report(spark.read.parquet(path)).select(*names).collect()]
    assert sorted(got, key=repr) == sorted(found.fetchall(), key=repr)
