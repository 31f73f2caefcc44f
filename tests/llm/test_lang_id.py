import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm.lang_id import ORDERS, UNKNOWN, best_temperature, bounds, bucket_counts, fit, length_class, predict

SYLLABLES = {"aa": ["tha", "ing", "ed", "ou", "wh"], "bb": ["ère", "eau", "ment", "qué", "oi"], "cc": ["ung", "sch", "ich", "ü", "keit"]}


def texts(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        lang = ("aa", "bb", "cc")[k % 3]
        words = ["".join(rng.choice(SYLLABLES[lang], size=rng.integers(1, 4))) for _ in range(rng.integers(3, 40))]
        rows.append((k, " ".join(words), lang, 5))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark.createDataFrame(texts(240, 1), "doc_id bigint, text string, lang string, score int"), rows_per_language=60)


def test_held_out_accuracy(spark, model):
    docs = spark.createDataFrame(texts(150, 2), "doc_id bigint, text string, lang string, score int").repartition(3)
    rows = predict(docs, model).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([r.rejected for r in rows]) < 0.02


def test_odd_texts(spark, model):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "123 $$$ --"), (4, "Ünung schich"), (5, "x"), (6, "日本語"), (7, "thing oued " * 20_000)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in predict(docs, model).collect()}
    for k in (1, 2, 3):
        assert rows[k].lang_pred == UNKNOWN and rows[k].score == 0 and rows[k].rejected
    assert rows[4].lang_pred == "cc" and rows[7].lang_pred == "aa" and not rows[7].rejected
    assert rows[5].lang_pred in model.languages and rows[6].lang_pred in model.languages
    assert predict(docs.where("false"), model).count() == 0


def test_the_order_and_partitions_of_rows_change_nothing(spark, model):
    docs = spark.createDataFrame(texts(240, 1)[::-1], "doc_id bigint, text string, lang string, score int").repartition(5)
    other = fit(docs, rows_per_language=60)
    assert np.array_equal(other.weights, model.weights) and other.temperature == model.temperature


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    assert [r.rejected for r in predict(docs, fit(docs)).collect()] == [True]
    assert fit(docs.where("false")).languages == [UNKNOWN]


@given(st.text(alphabet="ab zé.", max_size=30))
def test_n_grams_don_t_cross_words(text):
    words = "".join(c if c.isalpha() else " " for c in text).split()
    want = sum(max(0, len(w.encode()) + 2 - n + 1) for w in words for n in ORDERS) - sum(2 for _ in words)
    assert bucket_counts(text.encode()).sum() == want


def test_calibration():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 2000)
    logits = rng.normal(size=(2000, 3))
    logits[np.arange(2000), labels] += 2
    assert 2 < best_temperature(logits * 5, labels) < 3.2
    values, lengths = rng.normal(size=3000), np.repeat([0, 2, 5], 1000)
    values[lengths == 5] += 10
    low = bounds(values, lengths, 0.01)
    assert low[0] < np.quantile(values[lengths == 0], 0.01) and 5 < low[5] < 9 and low[1] < 0 < low[4]
    assert length_class(np.array([1, 16, 17, 4096, 4097])).tolist() == [0, 0, 1, 4, 5]


def test_noise_and_unlearned_languages_go_and_clean_texts_stay(spark, model):
    rng = np.random.default_rng(4)
    noise = ["".join(rng.choice(list("bcdfghjklmnpqrstvwxz0123456789 "), 400)) for _ in range(30)]
    other = [" ".join("".join(rng.choice(list("あいうえおかきくけこさしすせそ日本語学校"), 4)) for _ in range(60)) for _ in range(30)]
    greek = [" ".join("".join(rng.choice(["λογ", "ος", "και", "την", "εις", "αυ"], 3)) for _ in range(60)) for _ in range(30)]
    clean = [t for _, t, _, _ in texts(300, 9)]
    short = [" ".join(t.split()[:3]) for t in clean]
    rows = [(k, t) for k, t in enumerate([*noise, *other, *greek, *clean, *short])]
    gone = {r.doc_id for r in predict(spark.createDataFrame(rows, "doc_id bigint, text string"), model).where("rejected").collect()}
    assert len(gone & set(range(90))) >= 88
    assert len([k for k in gone if 90 <= k < 390]) == 0 and len([k for k in gone if k >= 390]) <= 3


def test_a_prediction_counted_anew(spark, model):
    """Scores and languages by plain sums over n-grams, one by one."""
    from tidemark.llm.lang_id import _SEEDS, BUCKET_BITS

    for (text,) in [("Ünung schich keit",), ("the thing oued",), ("x",)]:
        words = "".join(c.lower() if c.isascii() and c.isalpha() else c if not c.isascii() else " " for c in text).split()
        total, n = np.zeros(len(model.languages)), 0
        for word in words:
            padded = b" " + word.encode() + b" "
            for order in ORDERS:
                for at in range(len(padded) - order + 1):
                    gram = padded[at : at + order]
                    if order == 1 and gram == b" ":
                        continue
                    value = int.from_bytes(gram, "little")
                    bucket = ((value ^ (value >> 15)) * int(_SEEDS[order - 1]) % 2**32) >> (32 - BUCKET_BITS)
                    total += model.weights[bucket]
                    n += 1
        odds = np.exp((total / n + model.bias) / model.temperature)
        odds /= odds.sum()
        row = predict(spark.createDataFrame([(text,)], "text string"), model).first()
        assert row.lang_pred == model.languages[int(odds.argmax())] and abs(row.score - odds.max()) < 1e-5


def test_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, t, lang) for _, t, lang, _ in texts(240, 1)], "doc_id bigint, text string, lang string")
    learned = fit(docs, rows_per_language=60)
    rows = predict(docs, learned).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and np.mean([r.rejected for r in rows]) < 0.02
    same = spark.createDataFrame([(1, "the same text", "aa")] * 300, "doc_id bigint, text string, lang string")
    assert fit(same, rows_per_language=20).languages == ["aa"]


def test_a_column_named_as_a_result(spark, model):
    docs = spark.createDataFrame([("the thing", "mine")], "text string, score string")
    assert predict(docs, model, added=("a", "b", "c")).columns == ["text", "score", "a", "b", "c"]


def test_very_many_labels(spark):
    rows = [(k, f"w{k:04d}x word{k * 7:05d}y", f"l{k:04d}") for k in range(2000)]
    model = fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == sorted(lang for _, _, lang in rows) and model.weights.shape[1] == 2000
