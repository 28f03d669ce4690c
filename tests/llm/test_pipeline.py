"""The corpus pipeline against brute force on a small corpus: what each stage keeps, and the token files at the end."""

import random

import pytest
from test_copies import component_of

import corpus_pipeline
from patternloom.llm import token_files
from patternloom.llm.decontaminate import words_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    word = {"en": ["the", "ing", "ed", "wh", "st"], "fr": ["eau", "tion", "qu", "é", "le"]}
    prose = lambda lang, n: " ".join("".join(rng.choice(word[lang]) for _ in range(rng.randrange(2, 5))) for _ in range(n))
    rows = [(i, prose(lang := rng.choice(["en", "fr"]), rng.randrange(30, 80)), lang, rng.choice(["a", "b", "c"])) for i in range(60)]
    item = prose("en", 20)
    rows += [(100 + i, rows[i][1].replace(rows[i][1].split()[3], "qqq", 1), rows[i][2], "a") for i in range(10)]
    rows += [(200 + i, f"{prose('en', 30)} {item} {prose('en', 9)}", "en", None) for i in range(4)]
    rows += [(300, None, "en", "a"), (301, "123 ...", None, "b"), (302, "", None, "b"), (303, rows[0][1], None, None)]
    out = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(*r, 1, "h") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, h string").repartition(3).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
    return str(out), rows, item


def test_stages(spark, folder):
    path, rows, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    docs = corpus_pipeline.saved(corpus_pipeline.known_language(spark, docs, path), "t")
    kept = [r for r in rows if r[0] not in (300, 301, 302)]
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in kept) and docs.columns == names

    docs = corpus_pipeline.saved(corpus_pipeline.one_per_group(spark, docs, path), "t")
    kept.sort()
    _, root = component_of([r[1] for r in kept])
    kept = [r for i, r in enumerate(kept) if root[i] == i]
    assert sorted(r.doc_id for r in docs.collect()) == [r[0] for r in kept] and docs.columns == names

    docs = corpus_pipeline.saved(corpus_pipeline.without_benchmark(spark, docs, path), "t")
    windows = {tuple(words_of(item.encode())[k : k + 8]) for k in range(13)}
    holds = lambda t: any(tuple((w := words_of(t.encode()))[k : k + 8]) in windows for k in range(len(words_of(t.encode()))))
    kept = [r for r in kept if not holds(r[1])]
    assert sorted(r.doc_id for r in docs.collect()) == [r[0] for r in kept] and docs.columns == names
    assert not any(200 <= r[0] < 300 for r in kept)

    docs = corpus_pipeline.saved(corpus_pipeline.mixture(spark, docs, path), "t")
    assert docs.columns == names
    own, mixed = {}, {}
    for r in kept:
        own[r[3]] = own.get(r[3], 0) + len(r[1].split())
    for r in docs.collect():
        mixed[r.source] = mixed.get(r.source, 0) + len(r.text.split())
    assert abs(sum(mixed.values()) - 1.5 * sum(own.values())) <= 80 * len(own) and all(mixed[s] <= 2 * own[s] for s in mixed)

    out = corpus_pipeline.tokens(spark, docs, path).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted(r.doc_id for r in docs.collect())
    assert sum(r.n_tokens for r in out[:-1]) == out[-1].start


def test_whole_run(spark, folder):
    path = folder[0]
    assert corpus_pipeline.run(spark, path).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    assert token_files.vocabulary().endswith(".json")


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
