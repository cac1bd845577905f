"""The pipeline's stages on a small corpus, each against what it must do to its own input."""

import random

import corpus_pipeline as P
from crossgrain.llm import pii, simhash


def corpus():
    r, rows, labels = random.Random(6), [], []
    word = lambda: "".join(r.choice(["an", "er", "th", "on", "is", "re"]) for _ in range(r.randint(1, 4)))
    for k in range(160):
        good = k % 5 > 0
        words = [word() if good else word() + "***" for _ in range(r.randint(40, 200))]
        rows.append([k, " ".join(words) + ".", r.choice(["en", "de"]), r.choice(["src0", "src1"])])
        labels.append((k, int(good), 0))
    for k in range(160, 190):  # exact copies, and near ones with one word changed
        text = rows[k - 159][1]
        words = text.split()
        if k % 2:
            words[len(words) // 2] = "changed"
        rows.append([k, " ".join(words), "en", "src1"])
    rows += [[300, "write to me@host.org or +1 (375) 555-4393 " + " ".join(word() for _ in range(60)), "en", "src0"], [301, None, "en", "src0"], [302, "", None, None], [303, "x " * 40_000, "en", "src0"]]
    return [(*x, len(x[1] or "")) for x in rows], labels


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stage, seen = dict(P.STAGES), {}
    for name, _ in P.STAGES[:-1]:
        out = stage[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.count() == len(seen[name])
    y = {k: q for k, q, _ in labels}
    assert {k for k in seen["quality"] if k in y} == {k for k, q in y.items() if q}
    copies = {k: k - 159 for k in range(160, 190) if y.get(k - 159)}
    assert not set(copies) & set(seen["near_duplicates"]) and set(copies.values()) <= set(seen["near_duplicates"])
    assert set(seen["quality"]) - set(seen["near_duplicates"]) - set(copies) <= {302, 301}
    assert seen["private"].keys() == seen["near_duplicates"].keys()
    assert seen["private"][300]["text"].startswith("write to <email> or <phone> ")
    assert set(seen["mixture"]) < set(seen["private"])
    packed = stage["packed"](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(seen["mixture"])
    assert P.run(spark, str(tmp_path)).count() == len(packed)


def test_similar_groups_against_brute_force(spark):
    r = random.Random(1)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(400)]
        texts.append(base)
        texts.append(base[:200] + ["other"] + base[200:])
        texts.append([w if i % 4 else "z" + w for i, w in enumerate(base)])
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(0, len(texts), 3):
        assert got[k] == got[k + 1] == k and got[k + 2] == k + 2


def test_stages_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
    assert pii.redact(docs).count() == 0
