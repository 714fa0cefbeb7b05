import random

from pyspark.sql import Row

from newsloom.llm import language_id
from newsloom.llm.common import documents

SAMPLES = {"aa": "the cat sat on the mat and the dog sat on the log", "bb": "le chat est sur la table et le chien est dans la rue", "cc": "ñandú año"}


def brute_phrases(text, sample):
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        n, i = n + 1, j
    return n


def fold(text):
    return " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split())


def test_phrases_match_brute_force():
    model = language_id.Model(SAMPLES)
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choices("the catsonmdlgrué ñxß", k=rng.randint(1, 60)))
        folded = language_id.folded(__import__("numpy").frombuffer(text.encode("utf-32-le"), "uint32"))
        symbols = model.code[folded].astype("int32")
        got = model.phrases(symbols, __import__("numpy").array([0, len(symbols)]))[0].tolist() if len(symbols) else [0, 0, 0]
        plain = "".join(map(chr, folded))
        assert got == [brute_phrases(plain, fold(SAMPLES[k])) for k in model.languages], text


def test_blocks_and_batches_do_not_mix_texts():
    model = language_id.Model(SAMPLES)
    texts = ["the cat sat", "", "123 !", "le chien est dans la rue", "the dog " * 4000, "год"]
    together = model.predict(texts)
    assert [model.predict([t]) for t in texts] == [([a], [b]) for a, b in zip(*together, strict=True)]
    assert together[0][:5] == ["aa", "und", "und", "bb", "aa"]
    assert all(0 <= s <= 1 for s in together[1])


def test_rows(spark):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, lang=k, score="x") for i, (k, t) in enumerate([("aa", SAMPLES["aa"]), ("bb", SAMPLES["bb"])] * 8)] + [Row(doc_id=50, text=None, lang="aa", score="x"), Row(doc_id=None, text="the cat", lang=None, score="x")], "doc_id long, text string, lang string, score string")
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(docs).collect()}
    assert (0, "aa") in got and (1, "bb") in got and (50, "und") in got and (None, "aa") in got
    assert language_id.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", language_id.F.lit(None).cast("string"))).collect()} == {"und"}


def test_each_language_learns_from_what_it_has(spark):
    words = {"en": "the cat sat on the mat and dogs were barking at night", "fr": "le chien est dans la rue avec une petite maison bleue", "ja": "吾輩は猫である名前はまだ無いどこで生れたか", "ok": "ok", "no": "123"}
    rng = random.Random(5)
    say = lambda k, n: " ".join(rng.choices(words[k].split() if k != "ja" else list(words[k]), k=n))
    rows = [(i, k, say(k, n)) for i, (k, n) in enumerate([("en", 80), ("fr", 8), ("ja", 4000), ("no", 70)] * 12)] + [(i, "ok", "ok") for i in range(100, 104)] + [(i, "ja", "!") for i in range(200, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert sorted(language_id.sample(docs)) == ["en", "fr", "ja", "ok"]
    assert max(len(x) for x in language_id.sample(docs)["ja"].split("\n")) == language_id.SAMPLE_MAX
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert all(got[i] == k for i, k, _ in rows[:48] if k != "no")


def test_held_out_accuracy(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98


def test_many_letters_take_little_room():
    rng = random.Random(8)
    letters = [chr(0x4E00 + i) for i in range(5000)]
    samples = {f"l{k}": "".join(rng.choices(letters[k * 100 : k * 100 + 2900], k=6000)) for k in range(20)}
    model = language_id.Model(samples)
    assert sum(x.nbytes for x in (model.base, model.owner, model.target, model.begin, model.code)) < 100 << 20
    assert model.predict([samples["l3"][100:900], samples["l17"][5000:]])[0] == ["l3", "l17"]


def test_pieces_of_a_long_text_are_one_text(monkeypatch):
    model = language_id.Model(SAMPLES)
    rng = random.Random(9)
    texts = ["".join(rng.choices("the catsonmdlgrué ñxß..", k=n)) for n in (0, 1, 700, 3000, 2048)] + ["... 12", "   the cat" * 500]
    want = model._short(texts)
    monkeypatch.setattr(language_id, "PIECE", 640)
    for text, phrases, lettered in zip(texts, *want, strict=True):
        got = model._long(text)
        assert (got[0] == phrases).all() and got[1] == lettered
    assert model.predict(texts) == (lambda: (monkeypatch.undo(), model.predict(texts))[1])()


def test_one_text_of_the_right_length_does_not_replace_the_others(spark):
    rng = random.Random(6)
    words = "le chien est dans la rue avec une petite maison bleue et rouge".split()
    rows = [(i, "fr", " ".join(rng.choices(words, k=25))[:150]) for i in range(79)]
    short = language_id.sample(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    more = language_id.sample(spark.createDataFrame([*rows, (500, "fr", " ".join(rng.choices(words, k=60))[:230])], "doc_id long, lang string, text string"))
    assert len(more["fr"]) > 0.9 * len(short["fr"]) > 3000


def test_languages_are_bounded(spark):
    rows = [(i, f"l{i % 700:04}", "abc def " * 40) for i in range(2100)] + [(5000 + i, "zz", "ghi jkl " * 40) for i in range(8)]
    got = language_id.sample(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert len(got) == language_id.LANGUAGES and "zz" in got
