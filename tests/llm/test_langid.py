import base64
import random

import numpy as np
from pyspark.sql import functions as F

from conftest import SMALL
from frostline.llm import langid as L

WORDS = {"en": "the house and river with what every thought shall bring morning light".split(),
         "de": "der fluss und ein haus über schön nicht zwischen wäre jetzt morgen".split(),
         "fr": "le fleuve et une maison où était déjà très lumière matin français".split()}


def corpus(n, seed=1):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(WORDS[lang], k=r.randrange(5, 60))), lang) for i, lang in enumerate(r.choices(list(WORDS), k=n))]


def test_held_out_accuracy_and_defined_cases(spark):
    rows = corpus(600)
    fitted = L.fit(spark.createDataFrame(rows + [(9999, "no label", None), (None, "the river and the house", "en")], "doc_id long, text string, lang string"), 50)
    model = fitted.model()
    assert sorted(set(model.names)) == ["de", "en", "fr"]
    held = corpus(300, 2)
    odd = [(1, None, "en"), (2, "", "en"), (3, " 12 %% \n", "en"), (None, "the river with light", "en"), (4, "le matin " * 20000, "fr"), (4, "le matin " * 20000, "fr")]
    docs = spark.createDataFrame(held + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as rejected")
    got = L.identify(docs, fitted).collect()
    good = sum(r.lang == r.lang_pred for r in got[:300])
    assert good >= 295 and all(0 <= r.score <= 1 for r in got)
    assert [(r.lang_pred, r.score, r.rejected) for r in got[300:303]] == [("und", 0.0, True)] * 3
    assert [r.lang_pred for r in got[303:]] == ["en", "fr", "fr"]
    assert not any(r.rejected for r in got[:300])
    assert model.predict(["Это совсем другой язык, его нет среди известных".encode() * 5])[2][0]


def test_prediction_against_a_plain_nearest_centroid(spark):
    rows = corpus(400)
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 60).model()
    texts = [t.encode() for _, t, _ in corpus(60, 7)] + ["Это другой язык".encode(), "xq zj vv kk qq".encode() * 9]
    lang, score, out = model.predict(texts)
    for k, v in enumerate(L.vectors(texts)):
        v = [float(x) * float(w) for x, w in zip(v, model.idf)]
        size = sum(x * x for x in v) ** 0.5
        cosines = [sum(x * float(y) for x, y in zip(v, c)) / size for c in model.centroids]
        best = max(range(len(cosines)), key=lambda i: (cosines[i], -i))
        assert lang[k] == model.names[best] and abs(score[k] - cosines[best]) < 1e-5
        assert out[k] == (cosines[best] < L.REJECT_SHARE * (1 - model.radius[best]))
    assert out[-2:].any() and not out[:60].any()


def test_any_number_of_languages(spark, monkeypatch):
    """Passes over a few languages at a time give what one pass over all gives; 1,200 languages are learned."""
    rows = corpus(300)
    labelled, held = (spark.createDataFrame(r, "doc_id long, text string, lang string") for r in (rows, corpus(80, 2) + [(900, None, None), (901, "12 %", None)]))
    one = [tuple(r) for r in L.identify(held, L.fit(labelled, 40)).orderBy("doc_id").collect()]
    monkeypatch.setattr(L, "PASS_LANGUAGES", 1)
    fitted = L.fit(labelled, 40)
    assert fitted.passes == 3 and [tuple(r) for r in L.identify(held, fitted).orderBy("doc_id").collect()] == one
    monkeypatch.setattr(L, "PASS_LANGUAGES", 500)
    monkeypatch.setattr(L, "SENT_LANGUAGES", 1000)
    name = lambda i: "".join(chr(97 + i // 26 ** k % 26) for k in (2, 1, 0)) * 2
    many = L.fit(spark.createDataFrame([(i, f"{name(i)} " * 9, f"l{i}") for i in range(1200)], "doc_id long, text string, lang string"))
    assert many.passes == 3
    got = L.identify(spark.createDataFrame([(1, f"{name(1077)} " * 5), (2, None)], "doc_id long, text string"), many).collect()
    assert [(r.lang_pred, r.rejected) for r in got] == [("l1077", False), ("und", True)]


def test_vectors_against_plain_counts():
    text = "Ab 1 bé b".encode()
    folded, grams = [], {}
    for b in text:
        b = b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
        if b != 32 or not folded or folded[-1] != 32:
            folded.append(b)
    want = np.zeros(L.DIMENSIONS)
    for n in (1, 2, 3):
        for i in range(len(folded) - n + 1):
            h = 0
            for k in range(n):
                h = (h * 257 + folded[i + k] + k + 1) % 2 ** 32
            want[(h * 2654435761 % 2 ** 32) >> 20] += 1
            grams[n, i] = h
    got = L.vectors([b"xyz", text, b""])[1]
    assert np.allclose(got, np.log1p(want))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert [(r.lang_pred, r.score, r.rejected) for r in L.identify(docs, model).collect()] == [("und", 0.0, True)] * 2
    assert L.keep_known(docs).columns == docs.columns and L.identify(docs.limit(0), model).count() == 0


def test_query_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    got = L.op5_nearest_centroid(spark, SMALL).join(docs, "doc_id")
    r = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("share"), F.count("*").alias("n")).first()
    assert r["n"] > 20 and r["share"] >= 0.95


NOT_LEARNED = {
    "nl": "De oude man liep langzaam door de straten van de stad en dacht aan alles wat hij in zijn leven had gezien. Het was koud buiten, maar de zon scheen nog een beetje boven de daken. Niemand wist waar hij heen ging of waarom hij zo vroeg was opgestaan.",
    "it": "Il vecchio camminava lentamente per le strade della città e pensava a tutto quello che aveva visto nella sua vita. Faceva freddo, ma il sole splendeva ancora un poco sopra i tetti. Nessuno sapeva dove andasse o perché si fosse alzato così presto.",
    "pt": "O velho caminhava devagar pelas ruas da cidade e pensava em tudo o que tinha visto na sua vida. Estava frio lá fora, mas o sol ainda brilhava um pouco por cima dos telhados. Ninguém sabia para onde ele ia nem por que se tinha levantado tão cedo.",
    "pl": "Stary człowiek szedł powoli ulicami miasta i myślał o wszystkim, co widział w swoim życiu. Na dworze było zimno, ale słońce świeciło jeszcze trochę nad dachami. Nikt nie wiedział, dokąd idzie ani dlaczego wstał tak wcześnie rano.",
    "sv": "Den gamle mannen gick långsamt genom stadens gator och tänkte på allt som han hade sett i sitt liv. Det var kallt ute, men solen sken ännu lite över taken. Ingen visste vart han var på väg eller varför han hade stigit upp så tidigt.",
    "fi": "Vanha mies käveli hitaasti kaupungin katuja pitkin ja ajatteli kaikkea, mitä hän oli elämässään nähnyt. Ulkona oli kylmä, mutta aurinko paistoi vielä vähän kattojen yllä. Kukaan ei tiennyt, minne hän oli menossa tai miksi hän oli noussut niin varhain.",
    "tr": "Yaşlı adam şehrin sokaklarında yavaşça yürüyor ve hayatında gördüğü her şeyi düşünüyordu. Dışarısı soğuktu ama güneş hâlâ çatıların üzerinde biraz parlıyordu. Kimse onun nereye gittiğini ya da neden bu kadar erken kalktığını bilmiyordu.",
}


def test_latin_texts_of_no_learned_language_are_rejected(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    model = L.fit(docs.filter(L.learned_from())).model()
    far = [t.encode() for t in NOT_LEARNED.values()] + [base64.b64encode(random.Random(i).randbytes(n)) for i in range(20) for n in (120, 300, 2000)]
    assert model.predict(far)[2].all()
    known = [r.text.encode() for r in docs.filter(~L.learned_from() & F.length("text").between(200, 5000)).collect()]
    assert len(known) > 50 and model.predict(known)[2].mean() < 0.01


def test_no_centroid_of_a_single_outlier():
    r = np.random.default_rng(5)
    m = np.eye(40)[np.r_[[0] * 150, [1] * 150, range(2, 6)]] + r.random((304, 40)) / 10
    found, _ = L.k_means(L.unit(m), 4)
    rows = np.bincount((L.unit(m) @ found.T).argmax(axis=1), minlength=len(found))
    assert len(found) >= 2 and rows.min() >= 3
