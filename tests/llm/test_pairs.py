"""SimHash groups, decontamination and mixing against brute force."""

import random
import re

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from paramscan.llm import decontaminate, simhash_mih, wfq_mix

WORDS = re.compile(r"[^ \t\n\x0b\x0c\r]+")
ODD = [None, "", " \n ", "x", "X", "Ünï çødé Ünï", "a b", "A  B", "same words here again", "same words here again", " nbsp ", "word " * 3000, "z" * 50000]


def docs_frame(spark, texts, extra=True):
    rows = [(i, t, "en", f"src{i % 3}" if i % 5 else None, "clash", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp string, n int")
    return df.withColumnsRenamed({"n": "size"}) if extra else df.select("doc_id", "text", "lang", "source")


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lowered)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_groups(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(60)) for _ in range(6)]
    texts = list(ODD)
    for t in base:
        words = t.split()
        for _ in range(6):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "other"
            texts.append(" ".join(copy))
        texts.append(t)
    prints = [slow_fingerprint(t) for t in texts]
    groups = slow_groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_mih.near_duplicates(docs_frame(spark, texts)).collect()}
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in range(len(texts))}
    kept = simhash_mih.keep_one(docs_frame(spark, texts))
    assert kept.columns == docs_frame(spark, texts).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups))


def test_simhash_links_every_close_pair(spark):
    rng = np.random.default_rng(0)
    values = [0, (1 << 64) - 1]
    for _ in range(40):
        v = int(rng.integers(0, 1 << 63))
        values += [v, v ^ 7, v ^ (1 << 63), v ^ (1 << 31) ^ (1 << 32) ^ 1, v ^ 15]
    values = sorted({v - (1 << 64) if v >= 1 << 63 else v for v in values})
    got = {(r.u, r.v) for r in simhash_mih.links(spark.createDataFrame([(v,) for v in values], "fp long")).distinct().collect()}
    want = {(max(a, b), min(a, b)) for a in values for b in values if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert got == want


def test_simhash_hot_halves(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(simhash_mih, "HOT", 3)
    values = set()
    for _ in range(4):
        half = rng.getrandbits(32)
        others = [rng.getrandbits(32) for _ in range(3)]
        for _ in range(60):  # one half shared or nearly, the other near one of a few values
            other = rng.choice(others)
            for _ in range(rng.randrange(4)):
                other ^= 1 << rng.randrange(32)
            near = half ^ (1 << rng.randrange(32) if rng.random() < 0.4 else 0)
            values.add(near | other << 32 if rng.random() < 0.5 else other | near << 32)
    values = sorted({v - (1 << 64) if v >= 1 << 63 else v for v in values})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for small in (simhash_mih.BROADCAST_HOT, 0):
        monkeypatch.setattr(simhash_mih, "BROADCAST_HOT", small)
        for bits in (1, 2, 3):
            got = {(r.u, r.v) for r in simhash_mih.links(df, bits).distinct().collect()}
            assert got == {(max(a, b), min(a, b)) for a in values for b in values if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= bits}


def test_simhash_mutually_close_prints(spark):
    # no more than 128 fingerprints are all within 3 bits of one another; here all within one bit of two neighbours
    values = sorted({c ^ (1 << b if b < 63 else 0) for c in (0, 1) for b in range(64)})
    links = simhash_mih.links(spark.createDataFrame([(v,) for v in values], "fp long")).distinct()
    assert links.count() == len(values) * (len(values) - 1) // 2
    assert simhash_mih.components(links).select("root").distinct().collect() == [(0,)]


def test_keep_one_keeps_clashing_columns(spark):
    rows = [(1, "a b c", 9, "x", "r"), (1, "a b c", 9, "x", "r"), (None, "a b c", 9, "y", "s"), (2, "other text", 8, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row int, __print string, root string").withColumn("row", F.col("__row"))
    assert sorted(map(tuple, simhash_mih.keep_one(df).collect()), key=repr) == [(1, "a b c", 9, "x", "r", 9), (2, "other text", 8, "z", None, 8)]


def test_simhash_repeated_and_null_keys(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "quite another text here"), (None, "a b c"), (None, "only with null key"), (None, "only with null key"), (2, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, simhash_mih.keep_one(df).collect()), key=repr)
    assert kept == sorted([(1, "a b c"), (1, "quite another text here"), (None, "only with null key")], key=repr)
    empty = df.limit(0)
    assert simhash_mih.near_duplicates(empty).count() == 0 and simhash_mih.keep_one(empty).count() == 0


def slow_overlaps(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for j, t in items:
        q = words(t)
        if len(q) < 5:
            continue
        size = min(13, len(q))
        for i, d in docs:
            x = words(d)
            for shift in range(-len(q), len(x)):
                same = [int(0 <= p + shift < len(x) and q[p] == x[p + shift]) for p in range(len(q))]
                best = max(sum(same[s : s + size]) for s in range(len(q) - size + 1))
                if best >= -(-8 * size // 10):
                    out[i, j] = max(out.get((i, j), 0), best)
    return out


def test_decontamination(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(j, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(13, 40)))) for j in range(10)]
    items += [(10, "a b"), (11, None), (12, items[0][1]), (13, "")]
    docs = [(i, t) for i, t in enumerate(ODD)]
    for i in range(len(ODD), 90):
        q = rng.choice(items[:10])[1].split()
        at = rng.randrange(0, max(1, len(q) - 12))
        part = q[at : at + rng.randrange(8, 30)]
        for _ in range(rng.randrange(0, 4)):
            part[rng.randrange(len(part))] = "zz"
        docs.append((i, " ".join([rng.choice(vocabulary) for _ in range(rng.randrange(30))] + part + [rng.choice(vocabulary) for _ in range(rng.randrange(30))])))
    want = slow_overlaps(docs, items)
    df = docs_frame(spark, [t for _, t in docs])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("clash"))
    for limit in (10**6, 0):  # broadcast seeds, then shuffled ones
        got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.report(df, bench, broadcast_words=limit).collect()}
        assert got == want
    left = {r.doc_id for r in decontaminate.clean(df, bench).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in want}
    assert decontaminate.report(df.limit(0), bench).count() == 0 and decontaminate.clean(df, bench.limit(0)).count() == len(docs)


def test_merged_hits_keep_their_windows(spark):
    words = [f"q{i}" for i in range(30)]
    equal = {10, 11, 13, 14, 15, 16, 17, 19, 20, 21, 23, 24, 25}
    rng = random.Random(4)
    docs = [(0, " ".join(w if i in equal else "zz" for i, w in enumerate(words)))]
    docs += [(k, " ".join(w if rng.random() < 0.75 else "zz" for w in words)) for k in range(1, 200)]
    items = [(0, " ".join(words))]
    want = slow_overlaps(docs, items)
    assert want[0, 0] == 11 and len(want) < len(docs)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (10**6, 0):
        assert {(r.doc_id, r.item_id): r.matched for r in decontaminate.report(df, bench, broadcast_words=limit).collect()} == want


def test_masks_meet_every_similar_window():
    from itertools import combinations

    for gone in combinations(range(13), 2):
        assert any(all(at + m not in gone for m in mask) for mask in decontaminate.MASKS for at in range(13 - mask[-1]))


def test_short_items_meet_every_substitution():
    from itertools import combinations

    for n in range(5, 13):
        masks = [mask for mask, lengths in decontaminate.SHORT_MASKS.items() if n in lengths]
        for gone in combinations(range(n), n - -(-8 * n // 10)):
            assert any(all(at + m not in gone for m in mask) for mask in masks for at in range(n - mask[-1]))


def test_short_items_with_substitutions(spark):
    from itertools import combinations

    items = [(n, " ".join(f"s{n}x{i}" for i in range(n))) for n in range(5, 15)]
    texts = []
    for n, t in items:
        for gone in combinations(range(n), max(1, n - -(-8 * n // 10))):
            texts.append(" ".join(["some"] + ["zz" if i in gone else w for i, w in enumerate(t.split())] + ["more"]))
        texts += [t, " ".join(t.split()[1:]), " ".join(t.split()[:-1]), "zz " + " ".join(t.split()[3:])]
    docs = list(enumerate(texts))
    want = slow_overlaps(docs, items)
    assert {j for _, j in want} == {n for n, _ in items}
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (10**6, 0):
        assert {(r.doc_id, r.item_id): r.matched for r in decontaminate.report(df, bench, broadcast_words=limit).collect()} == want


def test_every_length_and_substitution_count(spark):
    """Items of 1 to 40 words, each copied with every number of substitutions that leaves 80 % of a window, and one more."""
    rng = random.Random(17)
    items = [(n, " ".join(f"i{n}x{i}" for i in range(n))) for n in range(1, 41)]
    docs = []
    for n, t in items:
        size = min(13, n)
        for gone in range(size - -(-8 * size // 10) + 2):
            for _ in range(4):
                words = t.split()
                start = rng.randrange(n - size + 1)
                for at in rng.sample(range(size), min(gone, size)):
                    words[start + at] = f"zz{rng.randrange(9)}"
                docs.append((len(docs), " ".join(["pad"] * rng.randrange(4) + words[start : start + size] + ["end"])))
    want = slow_overlaps(docs, items)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (10**6, 0):
        assert {(r.doc_id, r.item_id): r.matched for r in decontaminate.report(df, bench, broadcast_words=limit).collect()} == want
    assert {j for _, j in want} == set(range(5, 41))


def test_mix_equals_sql(spark, tmp_path):
    rng = random.Random(3)
    texts = list(ODD) + [" ".join("w" for _ in range(rng.randrange(1, 400))) for _ in range(120)]
    df = docs_frame(spark, texts).withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").otherwise(F.col("source")))
    path = str(tmp_path / "documents")
    df.write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = sorted(map(tuple, db.execute(wfq_mix.ORACLE).fetchall()))
    got = sorted(map(tuple, wfq_mix.mix(spark.read.parquet(path)).select("doc_id", "size", "source_size", "target", "taken").collect()))
    assert got == want
    again = sorted(map(tuple, wfq_mix.mix(spark.read.parquet(path).repartition(7)).select("doc_id", "size", "source_size", "target", "taken").collect()))
    assert again == got
    assert sum(r[4] for r in got) == sum(r[1] for r in got) and all(r[4] <= 3 * r[1] for r in got)


def test_mix_edges(spark):
    schema = "doc_id long, text string, source string"
    assert wfq_mix.mix(spark.createDataFrame([], schema)).count() == 0
    blank = wfq_mix.mix(spark.createDataFrame([(1, None, None), (2, " ", "a"), (None, "", "b")], schema)).collect()
    assert [(r["size"], r.taken) for r in blank] == [(0, 0)] * 3
    rows = wfq_mix.mix(spark.createDataFrame([(1, "a b", "s")] * 4 + [(None, "c", None)] * 2, schema)).collect()
    assert sum(r.taken for r in rows) == 10 and all(r.taken <= 3 * r["size"] for r in rows)


def test_targets_share_by_weight_and_cap(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(f"s{i:03d}" if i else None, rng.choice([0, 1, 10, 1000, 10**6]) * rng.randrange(1, 9)) for i in range(60)]
    sources = spark.createDataFrame(rows, "source string, source_size long")

    def slow():
        """Plain form: share what is left by weight among the open sources until none is above its cap."""
        order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
        weight = {r[0]: (5, 2, 1)[n % 3] for n, r in enumerate(order)}
        out, open_ones, left = {}, dict(rows), float(sum(n for _, n in rows))
        while open_ones:
            level = left / sum(weight[s] for s in open_ones)
            over = {s: 3.0 * n for s, n in open_ones.items() if weight[s] * level > 3 * n}
            if not over:
                return {**out, **{s: weight[s] * level for s in open_ones}}
            out |= over
            left -= sum(over.values())
            open_ones = {s: n for s, n in open_ones.items() if s not in over}
        return out

    want = slow()
    for small, ranged in ((wfq_mix.SMALL, wfq_mix.RANGE_ROWS), (0, 7)):
        monkeypatch.setattr(wfq_mix, "SMALL", small)
        monkeypatch.setattr(wfq_mix, "RANGE_ROWS", ranged)
        got = {r.source: r.target for r in wfq_mix.targets(sources).collect()}
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_mix_in_many_ranges(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i if i % 5 else None, "w " * (1 + i % 7), f"s{i % 4}" if i % 11 else None) for i in range(400)]
    rows += [(7, "the same row", "s1")] * 150  # repeated rows
    rows += [(None, "w " * rng.randrange(1, 9) + str(i), "s2") for i in range(150)]  # a null key on many texts
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, wfq_mix.mix(df).collect()), key=repr)
    monkeypatch.setattr(wfq_mix, "RANGE_ROWS", 20)
    sizes, inner = [], wfq_mix._placed

    def placed(*a):
        out = inner(*a)
        sizes.extend(r["count"] for r in out.groupBy("_range").count().collect())
        return out

    monkeypatch.setattr(wfq_mix, "_placed", placed)
    for small in (wfq_mix.SMALL, 0):
        monkeypatch.setattr(wfq_mix, "SMALL", small)
        assert sorted(map(tuple, wfq_mix.mix(df.repartition(7)).collect()), key=repr) == want
    assert max(sizes) < 100  # no source, key or group of equal rows is one range
