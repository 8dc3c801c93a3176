import random
import textwrap

import duckdb

from omicspark.llm import license_scan
from omicspark.llm.queries import oracle_sql, table

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, words string, row long"


def rows():
    notice = license_scan.TEMPLATES[13][1]
    short = [t for _, t in license_scan.TEMPLATES]
    rng = random.Random(3)
    texts = [
        None, "", " \n\r\n", "MIT License", "the mit   LICENSE, Apache/license\nGeneral Public, License mit license",
        "mit licenses", "émit license", "mit-license", "x mit\x00license\x7fapache license", "İmit license ß", "license mit",
        notice, notice.upper(), notice.replace("granted", "given"), notice.replace(" of ", "\n"), "a " * 50_000 + "mit license " * 3,
        "general public license general public license", "no words: ###", "Licensed under CC BY NC", "日本 mit license 語",
        "Released under the MIT\r\nLicense.", "released under the MIT licence agreement license",
    ]
    for _ in range(150):
        words = rng.choice(short).split() + rng.choice(short).split()[: rng.randint(0, 6)]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["the", "of", "License", "\n", "mit", "zzz"])
        if rng.random() < 0.3:
            rng.shuffle(words)
        texts.append(" ".join(words))
    made = [(i, t) for i, t in enumerate(texts)]
    return [(*r, "x", "x", 0, "x", 1) for r in made + made[3:6] + [(None, "mit license")]]


def compared(spark, docs, folder_docs):
    con = duckdb.connect()
    con.register("documents", folder_docs)
    want = con.execute(oracle_sql()["op5_license_scan"])
    names = [d[0] for d in want.description]
    found = license_scan.scan(docs)
    assert found.columns == names
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(want.fetchall(), key=key)
    return found


def test_odd_texts_equal_sql(spark):
    docs = spark.createDataFrame(rows(), SHAPE)
    found = compared(spark, docs, docs.toArrow())
    assert found.where("labels LIKE '%spdx%'").count() > 50


def test_plan_stays_in_the_engine(spark):
    plan = license_scan.scan(table(spark, "/root/testdata/sf0.001", "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_empty_table_and_no_notices(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.scan(empty).collect() == []
    docs = spark.createDataFrame([(1, "Released under the MIT License")], "doc_id long, text string")
    (row,) = license_scan.scan(docs, notices=()).collect()
    assert (row.n_base, row.labels, row.score) == (1, "mit", 0.0)


def test_containment_threshold(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "e d c x"), (3, "a b c"), (4, "a a a a b")], "doc_id long, text string")
    found = license_scan.scan(docs, notices=[("l", "a b c d e")], threshold=0.6).collect()
    assert {r.doc_id: (r.labels, round(r.score, 3)) for r in found} == {1: ("l", 0.8), 2: ("l", 0.6), 3: ("l", 0.6), 4: ("", 0.0)}


def test_windows_find_wrapped_notices_and_no_scattered_words(spark):
    texts, want = [], []
    for label, notice in license_scan.TEMPLATES:
        for width in (20, 40, 72):
            body = "# " + "\n# ".join(textwrap.wrap(f"Some file, version 3. Copyright by nobody. {notice}, and so on as usual.", width))
            texts.append(body)
            want.append(label)
    filler = " ".join(f"w{i}" for i in range(100))
    scattered = f" {filler} ".join(["Released", "under", "the", "MIT", "License"])
    long = f"{filler} " * 50 + "Released under the MIT License " + f"{filler} " * 50
    rows = list(enumerate([*texts, scattered, long, None, "", "mit"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in license_scan.scan(docs, windows=True).collect()}
    assert len(found) == len(rows)
    n = len(texts)
    assert all(label in found[i].labels.split(",") for i, label in enumerate(want))
    assert [(found[i].labels, found[i].score) for i in range(n, n + 5)] == [("", 0.0), ("mit,spdx:mit", 1.0), ("", 0.0), ("", 0.0), ("", 0.0)]
    assert license_scan.scan(docs, notices=(), windows=True).where("score > 0").count() == 0
    assert "Python" not in license_scan.scan(docs, windows=True)._jdf.queryExecution().toString()
