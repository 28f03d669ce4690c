"""Language identification: held-out accuracy, codewords, odd texts."""

import random

import numpy as np
import pytest

from patternloom.llm import language_id

SYLLABLES = {"aa": ["the", "ing", "ed", "wh", "st"], "bb": ["eau", "tion", "qu", "é", "le"], "cc": ["sch", "ung", "ä", "ein", "er"], "dd": ["ción", "ado", "os", "ñ", "la"]}


def make(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_codebook_keeps_words_apart():
    for n in (2, 4, 7, 12, 40):
        code = language_id.codebook(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n < 4 else 2 * n // 4 if n <= 7 else code.shape[1] // 5)
        assert all(len(set(bit)) == 2 for bit in code.T)


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(400)]
    rows = [(i, make(rng, lang, rng.randrange(3, 40)), lang) for i, lang in enumerate(langs)]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !?", "aa"), (902, "", None), (None, make(rng, "cc", 70_000), None)], "doc_id long, text string, lang string")
    model = language_id.learn(df.where(~language_id.held_out()))
    assert model.languages == sorted(SYLLABLES)
    got = {r.doc_id: r for r in language_id.identify(df.withColumn("held", language_id.held_out()), model).select("doc_id", "held", "judged.*").collect()}
    test = [i for i, *_ in rows if got[i].held]
    assert 60 < len(test) < 140 and np.mean([got[i].lang_pred == langs[i] for i in test]) >= 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].ambiguous for i in (900, 901, 902))
    assert got[None].lang_pred == "cc" and all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    model = language_id.learn(df)
    assert [r.judged.lang_pred for r in language_id.identify(df, model).collect()] == ["und"]
    assert language_id.identify(df.limit(0), model).count() == 0
    one = language_id.learn(df.selectExpr("doc_id", "text", "'xx' AS lang"))
    assert [r.judged.lang_pred for r in language_id.identify(df, one).collect()] == ["xx"]


def test_many_labels_and_clashing_columns(spark):
    rng = random.Random(2)
    rows = [(i % 50, make(rng, lang, 30), lang) for i in range(120) for lang in ("aa", "bb")] + [(i, "qqq zzz", f"odd{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(df, most_languages=2)
    assert model.languages == ["aa", "bb"]
    named = df.withColumnRenamed("lang", "judged")
    with pytest.raises(ValueError):
        language_id.identify(named, model)
    got = language_id.identify(named, model, out_col="found").collect()
    assert len(got) == len(rows) and np.mean([r.found.lang_pred == r.judged for r in got if len(r.judged) == 2]) > 0.97
