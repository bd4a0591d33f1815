"""The registered queries over a small corpus with null, empty, long and repeated rows: columns, types, rows, and scores against plain forms."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import slow_language

from paramscan.llm import langid_gru, quality_gam, queries, toxicity_subword
from paramscan.llm.common import key_mod

COLUMNS = {
    "op1_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op2_quality": "doc_id held_out score predicted",
    "op3_mix_sources": "doc_id size source_size target taken",
    "op4_toxicity": "doc_id held_out score predicted",
    "op5_language": "doc_id held_out lang_pred score",
    "op6_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op7_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op8_decontaminate": "doc_id item_id window matched similarity",
    "op9_token_counts": "doc_id n_pretokens n_tokens",
    "op10_simhash": "doc_id fingerprint component_id",
}
TYPES = {"held_out": "boolean", "score": "double", "predicted": "int", "lang_pred": "string", "taken": "bigint", "target": "double", "size": "bigint", "tail_crc32": "bigint", "n_assign": "bigint", "n_phone": "bigint", "fingerprint": "string"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    path = str(tmp_path_factory.mktemp("corpus"))
    syllables = {"aa": "ka lo mi tu ren".split(), "bb": "sch ei nt ung er".split()}
    rows, labels = [], []
    for i in range(260):
        lang = "ab"[i % 2] * 2
        words = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 80))]
        if i % 4 == 0:
            words.insert(rng.randrange(len(words)), "horrible")
        if i % 3 == 0:
            words = [w + "%%" for w in words]
        if i % 7 == 0:
            words.append("token=abcdef123456 a@b.co")
        rows.append((i, " ".join(words), lang if i % 9 else None, f"s{i % 3}", len(words), "x"))
        labels.append((i, int(i % 3 > 0), int(i % 4 == 0), 1.0))
    rows += [(300, None, None, None, None, None), (301, "", "aa", "s1", 0, ""), (302, "½ ² 12 !", "bb", "s1", 8, "x"), (303, rows[5][1] * 400, "bb", "s2", 1, "x"), (None, "ka lo mi", "aa", "s0", 8, "y"), (None, None, None, None, None, None)]
    rows += rows[:5] + [(5, "another text with the same key", "aa", "s1", 30, "z")]
    labels += labels[:3] + [(None, 1, 1, 1.0), (301, None, None, 1.0), (999, 1, 0, 1.0)]
    items = [(0, rows[8][1]), (1, None), (2, "too short")]
    # columns that operators use inside, with clashing names
    extra = "score double, held_out string, key string, size string, tokens int, h string, root int, item string"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")
    for c in extra.split(", "):
        name, kind = c.split()
        docs = docs.withColumn(name, F.lit("7").cast(kind))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text double").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_types_and_rows(spark, folder, name):
    out = queries.QUERIES[name](spark, folder)
    wanted = COLUMNS[name].split()
    assert set(wanted) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert all(dict(out.dtypes)[c] == t for c, t in TYPES.items() if c in wanted)
    keys = sorted((r.doc_id for r in out.select("doc_id").collect()), key=repr)
    everything = sorted((r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()), key=repr)
    assert set(keys) <= set(everything) if name == "op8_decontaminate" else keys == everything


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, folder, tmp_path, name):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def held(key, modulus, rest):
    return zlib.crc32(str("" if key is None else key).encode()) % modulus == rest


def test_quality_against_plain_form(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_gam.fit(docs, labels, key_mod(labels.doc_id, 3) != 1)
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    for r in queries.op2_quality(spark, folder).collect():
        assert r.held_out == held(r.doc_id, 3, 1) and r.predicted == int(r.score >= 0.5)
        assert any(abs(float(model.score(np.array([quality_gam.features(t)]))[0]) - r.score) < 1e-9 for k, t in texts if k == r.doc_id)


def test_toxicity_against_plain_form(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity_subword.fit(docs, labels, key_mod(labels.doc_id, 5) != 0)
    texts = {(r.doc_id, r.text) for r in docs.collect()}

    def slow_score(text):
        """Plain form: n-grams of each word with its edges one by one, a dict of passages."""
        data = b" " + b" ".join((text or "").encode().translate(toxicity_subword.FOLD).split()) + b" "
        total, count, cells = 0.0, 0, {}
        for n in toxicity_subword.LENGTHS:
            for at in range(len(data) - n + 1):
                gram = data[at : at + n]
                if b" " in gram[1:-1]:
                    continue
                h = gram[0] + 1
                for byte in gram[1:]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ (byte + 1)
                h = h * 0x9E3779B1 & 0xFFFFFFFF
                value = float(model.margin[(h >> 7 ^ h >> 19) & toxicity_subword.BUCKETS - 1])
                total, count = total + value, count + 1
                for passage in (at // toxicity_subword.CELL, at // toxicity_subword.CELL + 1):
                    s, k = cells.get(passage, (0.0, 0))
                    cells[passage] = s + value, k + 1
        whole = {at: v for at, v in cells.items() if at <= (len(data) - 3) // toxicity_subword.CELL}
        peak = max((s / (k + toxicity_subword.PASSAGE_SMOOTH) for s, k in whole.values()), default=0.0)
        z = model.bias + model.mean * total / (count + toxicity_subword.SMOOTH) + model.peak * peak
        return 1 / (1 + np.exp(-z))

    for r in queries.op4_toxicity(spark, folder).collect():
        assert r.held_out == held(r.doc_id, 5, 0) and r.predicted == int(r.score >= 0.5)
        mine = [t for k, t in texts if k == r.doc_id]
        if all(len(t or "") < 5000 for t in mine):
            assert any(abs(slow_score(t) - r.score) < 1e-4 for t in mine), (r, [slow_score(t) for t in mine])


def test_language_against_plain_form(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    net = langid_gru.fit(docs, key_mod(docs.doc_id, 5) != 0)
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    for r in queries.op5_language(spark, folder).collect():
        assert r.held_out == held(r.doc_id, 5, 0)
        slow = [slow_language(net, t) for k, t in texts if k == r.doc_id and len(t or "") < 5000]
        assert not slow or any(lang == r.lang_pred and abs(p - r.score) < 0.02 for lang, p in slow)


def test_samples_repeat(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    turned = docs.repartition(9, "text"), labels.repartition(5)
    a, b = (toxicity_subword.fit(d, m, key_mod(m.doc_id, 5) != 0) for d, m in ((docs, labels), turned))
    assert np.array_equal(a.margin, b.margin) and (a.bias, a.mean, a.peak) == (b.bias, b.mean, b.peak)
    a, b = (quality_gam.fit(d, m, key_mod(m.doc_id, 3) != 1) for d, m in ((docs, labels), turned))
    assert a.bias == b.bias and all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables))
