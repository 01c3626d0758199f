import zlib

import corpus_pipeline as p
import pytest

from eventweir.llm import queries

from .test_ngram_join import brute as components
from .test_line_dedup import brute as without_lines
from .test_decontaminate import brute as contaminated
from .test_toxicity import corpus


@pytest.fixture
def folder_of_tables(table, folder, words):
    made = corpus(260)
    shared, item = "This line stands everywhere.", words(900, 25)
    texts = [f"{shared}\n{text}" if i % 3 == 0 else text for i, (_, text, _) in enumerate(made)]
    texts[50] = texts[51] = texts[49]
    texts[60] += "\n" + item
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(texts)] + [(1000, None, None, None, None), (1001, "", "en", "src", 0)]
    path = folder("tables")
    table(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    table([(i, 1, x) for i, _, x in made], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    table([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def test_stages_follow_each_other(spark, folder_of_tables):
    path, rows, item = folder_of_tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in p.clean_tone(spark, docs, path).collect()}
    toxic = {i for i, _, x in corpus(260) if x and zlib.crc32(str(i).encode()) % 4 != 2}
    assert not toxic & set(kept) - {50, 51} and {1000, 1001} <= set(kept)

    cleaned = without_lines(kept.values(), 10)
    kept = {i: text if n else kept[i] for i, (text, _, n) in zip(kept, cleaned, strict=True)}
    kept = {i: kept[i] for i, _, least in components(list(kept.items())) if i == least}
    kept = {i: t for i, t in kept.items() if not contaminated(t, [(1, item)])[-1]}
    got = {r["doc_id"]: r["text"] for r in p.run(spark, path).collect()}
    assert got == {i: t or "" for i, t in kept.items()}


def test_stages_keep_the_columns(spark, folder_of_tables):
    path, _, _ = folder_of_tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, path).columns == p.COLUMNS


def test_every_operator_has_a_query():
    assert {int(name[2:].split("_")[0]) for name in queries.QUERIES if name.startswith("op")} == set(range(1, 14))
    assert "pipeline" in queries.QUERIES
