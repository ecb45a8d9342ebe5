"""Language identification: held-out accuracy, and the model against a plain recount."""

import numpy as np
from pyspark.sql import functions as F

from sightline.llm import language
from sightline.llm.language import learn_languages, n_grams, predict_languages

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("uri"), F.col("text").alias("content"), F.col("lang").alias("language"))
    rows = rows.withColumn("held_out", F.crc32(F.col("uri").cast("string")) % 4 == 2)
    model = learn_languages(rows.where("NOT held_out"))
    got = predict_languages(rows, model).withColumnRenamed("language", "said").join(rows, "uri").where("held_out").toPandas()
    letters = got[got.said != "und"]
    assert (letters.said == letters.language).mean() > 0.99 and len(letters) > 0.95 * len(got)


def test_model_counts_everything(spark):
    rows = [("the cat", "en"), ("der Hund", "de"), ("the dog", "en"), (None, "en"), ("lost", None), ("12 34", "fr")]
    model = learn_languages(spark.createDataFrame(rows, "content string, language string").repartition(3), smoothing=0.5, buckets=64)
    assert model.languages == ["de", "en", "fr"]
    assert np.allclose(np.exp(model.prior), [0.25, 0.5, 0.25])
    for j, texts in enumerate((["der Hund"], ["the cat", "the dog"], ["12 34"])):
        counts = 0.5 + np.bincount(n_grams(texts, 64)[1], minlength=64)
        assert np.allclose(model.matrix[:, j], np.log(counts / counts.sum()))


def test_n_grams_of_each_text():
    texts = ["Ab c", "", "a\n\t9b", "ß🙂é"]
    owner, place = n_grams(texts)
    for i, text in enumerate(texts):
        alone = n_grams([text])[1]
        assert sorted(place[owner == i]) == sorted(alone)
    assert len(n_grams(["ab"])[1]) == 2 + 3 + 2  # a b, _a ab b_, _ab ab_


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(language, "CHARACTERS_AT_ONCE", 50)
    frame = spark.createDataFrame([(1, "wo ist der Hund " * 30, "de", "x"), (2, "where is the dog " * 30, "en", "x")], "uri int, content string, language string, score string")
    model = learn_languages(frame)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " 12 %$ \n"), (4, "dog"), (4, "dog"), (None, "Hund"), (5, "the dog " * 2000)], "uri int, content string")
    got = sorted([(str(r.uri), r.language) for r in predict_languages(odd, model).collect()])
    assert got == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("4", "en"), ("5", "en"), ("None", "de")]
    assert all(0 <= r.score <= 1 for r in predict_languages(odd, model).collect())
    assert predict_languages(odd.limit(0), model).count() == 0
    unlearned = learn_languages(frame.limit(0))
    assert {r.language for r in predict_languages(odd, unlearned).collect()} == {"und"}


def test_parts_have_the_n_grams_of_the_whole(monkeypatch):
    texts = ["".join(np.random.default_rng(i).choice(list("abcé ΣİΑ\n9 Xy ßж"), 400)) for i in range(12)] + [" ", "x" * 300, "ab " * 200, None, ""]
    whole = [np.sort(n_grams([t])[1]).tolist() for t in texts if t]
    for size in (7, 50, 131):
        monkeypatch.setattr(language, "CHARACTERS_AT_ONCE", size)
        found: dict[int, list[int]] = {}
        parts = 0
        for at, some in language.chunks(texts):
            owner, place = n_grams(some)
            parts += len(some)
            for i, p in zip(at[owner].tolist(), place.tolist()):
                found.setdefault(i, []).append(p)
        assert [sorted(found.get(i, [])) for i, t in enumerate(texts) if t] == whole
        assert parts > len(texts)


def test_many_languages(spark, monkeypatch):
    draw = np.random.default_rng(1)
    rows = [(i, "".join(draw.choice(list("abcdefgh"), 40, p=draw.dirichlet([0.3] * 8))), f"l{i % 300:03d}") for i in range(600)]
    table = spark.createDataFrame([*rows, (None, "abc", None), (1000, "12", "l001")], "uri int, content string, language string")
    monkeypatch.setattr(language, "MOST_LANGUAGES", 300)
    one = learn_languages(table, buckets=512)
    want = {r.uri: (r.language, r.score, r.fit) for r in predict_languages(table, one).collect()}
    monkeypatch.setattr(language, "MOST_LANGUAGES", 70)
    many = learn_languages(table, buckets=512)
    assert len(many.languages) == len(one.languages) == 300 and len(list(many.blocks())) == 5
    got = {r.uri: (r.language, r.score, r.fit) for r in predict_languages(table, many).collect()}
    assert {u: g[0] for u, g in got.items()} == {u: w[0] for u, w in want.items()}
    assert all(np.allclose([got[u][1], got[u][2] or 0], [want[u][1], want[u][2] or 0]) for u in want)


def test_fit_tells_unlearned_languages(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("uri"), F.col("text").alias("content"), F.col("lang").alias("language"))
    model = learn_languages(rows.where("language <> 'de'"))
    got = predict_languages(rows, model).withColumnRenamed("language", "said").join(rows.select("uri", "language"), "uri").where("n_grams > 300").toPandas()
    usual = got.fit >= -(1 + 6 / np.sqrt(got.n_grams))
    assert usual[got.language != "de"].mean() > 0.99 and usual[got.language == "de"].mean() < 0.05
    noise = spark.createDataFrame([(1, "".join(np.random.default_rng(2).choice(list("zqxjkvwpfыжщ "), 3000)))], "uri int, content string")
    odd = predict_languages(noise, model).first()
    assert odd.score > 0.9 and odd.fit < -(1 + 6 / np.sqrt(odd.n_grams))
