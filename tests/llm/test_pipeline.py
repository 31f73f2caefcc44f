"""The stages on planted documents, each against what it should do to its own input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    parts = {"en": ["tha", "ing", "ed", "ou", "wh"], "fr": ["ère", "eau", "ment", "qué", "oi"]}
    word = lambda lang: "".join(rng.choice(parts[lang], size=rng.integers(2, 4)))
    line = lambda lang, n=12: " ".join(word(lang) for _ in range(n))
    docs = [(k, "\n".join(line(lang) for _ in range(6)), lang) for k in range(120) for lang in [("en", "fr")[k % 2]]]
    item = line("en", 30)
    base = line("en", 90).split()
    near = list(base)
    near[40] = "zz"
    docs += [(200, "12 34 $$", None), (201, None, None), (202, docs[0][1] + "\nnew last line", "en"), (203, f"start {item} end", "en"), (204, " ".join(base), "en"), (205, " ".join(near), "en")]
    path = tmp_path_factory.mktemp("data")
    rows = [(k, t, lang, "s", len(t) if t is not None else None) for k, t, lang in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), dict((k, t) for k, t, _ in docs)


def test_stages(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    want = {"language_id": set(texts) - {200, 201}, "line_dedup": set(texts) - {200, 201}, "near_duplicates": set(texts) - {200, 201, 205}, "decontamination": set(texts) - {200, 201, 203, 205}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, path))
        assert docs.columns == columns
        kept = {r.doc_id: r for r in docs.collect()}
        assert set(kept) == want[name], name
        if name == "line_dedup":
            assert kept[202].text == "new last line" and kept[202].n_chars == 13
            assert all(kept[k].text == texts[k] for k in kept if k != 202)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id for r in packed} == want["decontamination"]
    whole = corpus_pipeline.run(spark, path).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)


def test_entry_names():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(queries()) | {"pipeline"} <= names and set(oracle_sql()) <= set(queries())


CLASHES = {"score": "mine", "lang_pred": "mine", "rejected": "mine", "lines_removed": "mine", "_tidemark_id": "mine", "n": "mine", "item_id": "mine", "component_id": "mine"}


def test_columns_that_bear_the_operators_names_stay(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({k: F.lit(v) for k, v in CLASHES.items()})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, path))
        assert all(docs.where(F.col(k) != v).isEmpty() for k, v in CLASHES.items())
    assert docs.columns[5:] == list(CLASHES) and docs.count() > 100


def test_empty_tables_nulls_and_repeated_rows(spark, folder, tmp_path):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), path).count() == 0
    extra = spark.createDataFrame([(None, texts[0], "en", None, None), (None, None, None, None, None), (300, "", None, None, 0)], docs.schema)
    twice = docs.union(docs).union(extra)
    kept = twice
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.saved(stage(spark, kept, path))
    counts = {r.doc_id: r["count"] for r in kept.groupBy("doc_id").count().collect()}
    assert counts.pop(None) == 1 and set(counts.values()) == {2} and set(counts) == set(texts) - {200, 201, 203, 205}
    nothing = docs.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"))
    assert corpus_pipeline.language_id(spark, nothing, path).count() == 0
    assert corpus_pipeline.line_dedup(spark, nothing, path).count() == corpus_pipeline.near_duplicates(spark, nothing, path).count() == docs.count()


def test_stages_against_brute_force(spark, tmp_path):
    """Random documents through line dedup, near duplicates and decontamination; each stage recomputed plainly from what the one before kept."""
    from test_line_dedup import brute as lines_brute
    from test_ngram_join import brute as near_brute
    from test_ngram_join import near_copies

    rng = np.random.default_rng(3)
    item = " ".join(f"item{k}" for k in range(25))
    rows = []
    for k, text in near_copies(5, groups=4, copies=6):
        words = text.split()
        if k % 7 == 0:
            words[10:10] = [w if rng.random() > 0.1 else "other" for w in item.split()]
        rows.append((k, "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)), "en", "s", 1))
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    have = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    docs = corpus_pipeline.saved(stages["line_dedup"](spark, docs, str(tmp_path)))
    want = {k: text for k, text, _ in lines_brute(list(have.items()))}
    assert {r.doc_id: r.text for r in docs.collect()} == want
    docs = corpus_pipeline.saved(stages["near_duplicates"](spark, docs, str(tmp_path)))
    want = {k: want[k] for k, (_, component) in near_brute(list(want.items())).items() if k == component}
    assert {r.doc_id: r.text for r in docs.collect()} == want

    def holds(text):
        words, wanted = text.split(), item.split()
        for start in range(-len(wanted), len(words)):
            same = [0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(wanted)]
            if any(sum(same[i : i + 20]) >= 15 and 0 <= start + i and start + i + 20 <= len(words) for i in range(len(wanted) - 19)):
                return True
        return False

    docs = stages["decontamination"](spark, docs, str(tmp_path))
    left = {k: t for k, t in want.items() if not holds(t)}
    assert {r.doc_id: r.text for r in docs.collect()} == left and len(left) < len(want)
