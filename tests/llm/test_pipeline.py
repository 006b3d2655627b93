"""Every stage of the pipeline held against its brute-force version, each on what the stage before it really returned."""

import random

import corpus_pipeline
import pytest
import test_decontaminate
import test_lines
import test_simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = line(30)
    shared = line(25)
    docs, labels = [], []
    for i in range(150):
        text = "\n".join(line(rng.randint(8, 30)) for _ in range(3))
        grade = rng.choice([0, 2, 2])
        if grade == 0:
            words = text.split(" ")
            for k in range(0, len(words), 4):
                words[k] = rng.choice(["zork", "zarkle", "zimbo"])
            text = " ".join(words)
        if i % 10 == 3:
            text += "\n" + shared
        if i % 25 == 4:
            text = text + " " + item + " tail"
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(grade == 2), int(grade == 0)))
    docs += [(200 + i, docs[i][1], "en", "s", docs[i][4]) for i in (1, 2, 5)]
    docs += [(300, None, "en", "s", None), (301, "", None, None, 0)]
    return docs, labels, [(1, item), (2, "short thing")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels, items = corpus()
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    given, labels, items = corpus()
    toxic = {i for i, _, t in labels if t}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        step(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        rows = after.collect()
        if k < 4:
            assert after.columns == columns
            assert all(r.text is None or r.n_chars == len(r.text) for r in rows)
            now = {r.doc_id: r.text for r in rows}
        pairs = [(i, r.text) for i, r in before.items()]
        if k == 0:
            gone = set(before) - set(now)
            assert len(gone & toxic) > 0.9 * len(toxic) and len(gone - toxic) <= 6
            assert all(now[i] == before[i].text for i in now)
        elif k == 1:
            want = test_lines.brute(pairs)
            assert set(now) == set(want) and sum(now[i] == t for i, t in want.items()) >= len(want) - 2
        elif k == 2:
            assert set(now) == {i for i, (_, least) in test_simhash.brute(pairs).items() if i == least}
        elif k == 3:
            hit = {i: h for i, _, h, _ in test_decontaminate.brute(pairs, items)}
            assert set(now) == set(before)
            assert all((now[i] == before[i].text) == (not h) for i, h in hit.items() if before[i].text is not None)
            assert all(not h for _, _, h, _ in test_decontaminate.brute(list(now.items()), items))
        else:
            from quire.llm.packing import Encoder, default_tokenizer

            ids = Encoder(default_tokenizer()).encode([t or "" for _, t in pairs])
            assert sum(r.length for r in rows) == sum(len(x) // 4 + 1 for x in ids)
            assert {r.doc_id for r in rows} == set(before)
        docs = after
    assert sorted(map(str, corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(str, after.select("doc_id", "start", "length", "ids_crc32").collect()))
