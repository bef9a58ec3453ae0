import numpy as np
import pyarrow as pa

from gleaner.llm import language_id
from gleaner.llm.language_id import LanguageIdParams

ENGLISH = "the cat and the dog went with the other animals to their house in the north"
FRENCH = "le chat et les chiens sont allés avec leurs amis à la maison près de la forêt"
GERMAN = "die Katze und der Hund gehen mit den anderen Tieren nach Hause über die Straße"


def learned(spark, params=None):
    rows = [(t, lang) for t, lang in ((ENGLISH, "en"), (FRENCH, "fr"), (GERMAN, "de")) for _ in range(3)]
    rows += [(None, "en"), ("text without label", None), ("", "en")]
    return language_id.fit(spark.createDataFrame(rows, "text string, lang string"), params)


def test_filter_contains_what_it_learned(spark):
    model = learned(spark)
    for text, lang in ((ENGLISH, "en"), (FRENCH, "fr"), (GERMAN, "de")):
        names, scores = language_id.predict_texts(model, pa.array([text]))
        assert names == [lang] and scores[0] > 0.9


def test_small_filter_is_corrected_for_false_positives(spark):
    """With a crowded filter most n-grams seem to be in all languages; the fill tells."""
    model = learned(spark, LanguageIdParams(slots=256, hashes=1))
    assert (model.false_positive > 0.1).all()
    unknown = "zzyzx qwfp jluy"
    _, score = language_id.predict_texts(model, pa.array([unknown]))
    grams, _ = language_id.n_grams(pa.array([unknown]), model.params.orders)
    assert score[0] < 0.6 and len(grams)
    names, _ = language_id.predict_texts(model, pa.array([ENGLISH, FRENCH, GERMAN]))
    assert names == ["en", "fr", "de"]


def test_more_than_64_languages(spark):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    words = [f"{a}{b}{a}{b}q" for a in alphabet[:9] for b in alphabet[9:18]]
    rows = [(w + " " + w, f"l{i:02d}") for i, w in enumerate(words)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    names, _ = language_id.predict_texts(model, pa.array([w for w in words]))
    assert np.mean([n == f"l{i:02d}" for i, n in enumerate(names)]) == 1
    assert model.table.shape[1] == 2


def test_awkward_rows(spark, docs, rows, no_docs):
    model = language_id.fit(docs)
    out = language_id.predict(docs, model)
    assert sorted(out.columns) == sorted([*docs.columns, "lang_pred"])  # score is replaced
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "fr") and 0 <= r.score <= 1
    assert language_id.predict(no_docs, model).count() == 0
    nothing = language_id.fit(no_docs)
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_texts_do_not_run_into_each_other():
    together, owners = language_id.n_grams(pa.array(["ab", "cd"]), (2, 3))
    apart = [language_id.n_grams(pa.array([t]), (2, 3))[0] for t in ("ab", "cd")]
    assert sorted(together.tolist()) == sorted(np.concatenate(apart).tolist())
    assert np.bincount(owners).tolist() == [len(a) for a in apart]


def test_filter_grows_with_what_a_language_holds(spark):
    rng = np.random.default_rng(3)

    def text(letters, n):
        return " ".join("".join(rng.choice(list(letters), 6)) for _ in range(n))

    large = text("abcdefghijklm", 3000)
    rows = [(large, "large"), (large, "large"), ("xyz zyx xzy", "small"), ("xyz zyx xzy", "small")]
    table = spark.createDataFrame(rows, "text string, lang string")
    model = language_id.fit(table, LanguageIdParams(slots=1 << 10))
    assert model.params.slots > 1 << 10 and (model.false_positive <= 0.55**3).all()
    names, scores = language_id.predict_texts(model, pa.array([text("nopqrstuvw", 30) for _ in range(20)]))
    assert (scores < 0.3).all()
    names, _ = language_id.predict_texts(model, pa.array([large, "xyz zyx xzy"]))
    assert names == ["large", "small"]


def test_slots_of_large_filters_are_independent():
    params = LanguageIdParams(slots=1 << 26)
    gram = np.arange(1 << 20, dtype=np.uint64)
    slots = [language_id._slot(language_id.words.mix64(gram), k, params) for k in range(3)]
    for a, b in ((0, 1), (0, 2), (1, 2)):
        assert abs(np.corrcoef(slots[a], slots[b])[0, 1]) < 0.01
    assert language_id._slots_for(10_000_000, LanguageIdParams()) == 1 << 26
    assert language_id._slots_for(13_000, LanguageIdParams()) == 1 << 22
