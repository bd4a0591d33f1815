"""The pipeline against brute force, stage by stage, each on its own input."""

import random
import re

import duckdb
from test_pairs import slow_fingerprint, slow_groups, slow_overlaps

import corpus_pipeline
from paramscan.llm import secret_dfa, toxicity_subword, wfq_mix
from paramscan.llm.common import key_mod


def corpus(folder, spark):
    rng = random.Random(8)
    syllables = "ka lo mi tu ren sol ver".split()
    text = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    items = [(j, text(30)) for j in range(4)]
    rows, labels = [], []
    for i in range(400):
        t, toxic = text(rng.randrange(10, 90)), i % 5 == 0
        if toxic:
            t += " horrible"
        if i % 17 == 3:
            t += " " + items[i % 4][1]
        if i % 19 == 4:
            t += " token = 'abcdef123456'"
        rows.append((i, t, "en", f"src{i % 3}", len(t)))
        labels.append((i, 1, int(toxic)))
    rows += [(400 + i, rows[i + 1][1], "en", "src0", len(rows[i + 1][1])) for i in range(30)]
    rows += [(500, None, None, None, None), (501, "", "en", "src1", 0), (502, rows[7][1] + " " + "long " * 20000, "en", "src2", 100)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def test_stages_equal_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    items = corpus(folder, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    before = {r.doc_id: r for r in docs.collect()}

    def after(k, frame):
        out = corpus_pipeline.STAGES[k][1](spark, frame, folder)
        out.write.parquet(f"{folder}/out{k}")
        out = spark.read.parquet(f"{folder}/out{k}")
        assert k == 4 or out.columns == names
        return out

    one = after(0, docs)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity_subword.fit(docs, labels, key_mod(labels.doc_id, 5) != 0)
    kept = {i for i, r in before.items() if model.score(r.text) < 0.5}
    assert {r.doc_id for r in one.collect()} == kept and 330 < len(kept) < len(before)

    two = after(1, one)
    ids = sorted(kept)
    groups = slow_groups([slow_fingerprint(before[i].text) for i in ids])
    kept = {ids[g] for g in groups}
    assert {r.doc_id for r in two.collect()} == kept

    three = after(2, two)
    bad = {i for i, _ in slow_overlaps([(i, before[i].text) for i in sorted(kept)], items)}
    assert bad and {r.doc_id for r in three.collect()} == kept - bad

    four = after(3, three)
    auto = secret_dfa.compile_rules()
    changed = 0
    for r in four.collect():
        old = before[r.doc_id]
        spans = secret_dfa.find_secrets(old.text, auto)
        if spans:
            changed += 1
            assert r.text == re.sub(r"token = 'abcdef123456", "[assign]", old.text) and r.n_chars == len(r.text)
        else:
            assert tuple(r) == tuple(old)
    assert changed

    five = after(4, four)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/out3/*.parquet')")
    want = sorted(map(tuple, db.execute(wfq_mix.ORACLE).fetchall()), key=repr)
    got = five.select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(tuple, got.collect()), key=repr) == want

    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=repr) == sorted(map(tuple, five.collect()), key=repr)


def test_stages_take_empty_and_extra(spark, tmp_path):
    folder = str(tmp_path)
    corpus(folder, spark)
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("fp", F.lit(1)).withColumn("toxicity", F.lit("x")).withColumn("seed", F.lit(2))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).count() == 0
        assert stage(spark, docs, folder).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_stages_take_null_and_repeated_keys(spark, tmp_path):
    folder = str(tmp_path)
    corpus(folder, spark)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clean = "ka lo mi tu ren sol ver ka mi lo ver tu"
    rows = [(None, clean, "en", "a", 9), (None, "another " + clean, "en", None, 9), (None, None, None, None, None), (7, "one text sol ren", "en", "a", 9), (7, "quite other words here", "en", "b", 9), (7, "one text sol ren", "en", "a", 9)]
    docs = spark.createDataFrame(rows, schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = sorted(map(tuple, stage(spark, docs, folder).collect()), key=repr)
        want = rows
        if k == 1:  # equal texts of equal keys are one document; the others differ
            prints = [slow_fingerprint(r[1]) for r in rows]
            assert len(set(slow_groups(prints))) == len(kept) == 5
            want = rows[:5]
        assert kept == sorted(want, key=repr), k
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(mixed) == len(rows) and sum(r.taken for r in mixed) == sum(r["size"] for r in mixed)
