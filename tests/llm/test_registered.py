"""The registered queries, the pipeline and its stages."""

import re
import tracemalloc

import brute
import duckdb
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from txnflow.llm import language_id, rows, tokens
from txnflow.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    result = entry.queries()[name](spark, sf_dir)
    assert sorted(result.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in result.select(*columns).collect()) == sorted(map(repr, cursor.fetchall()))


def test_stages_keep_the_columns_and_take_effect(spark, edges, edge_rows, sf_dir):
    docs = edges
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == edges.columns, name
    left = {r.doc_id for r in docs.collect()}
    assert left < {r[0] for r in edge_rows}
    assert not left & {0, 1, 2, 6, 9}  # without a letter, or a copy


def test_near_copies_are_those_of_five_words(spark, sf_dir):
    words = [f"v{i}" for i in range(50)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:25], "z", *words[26:]])), (3, " ".join([*words[:20], "z", *words[21:25], "y", *words[26:]]))]
    groups = brute.ngram_links(docs, 5, 80)
    assert groups != brute.ngram_links(docs)
    kept = corpus_pipeline.distinct(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)


def test_pipeline_equals_plain_stages(spark, sf_dir):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = [r.asDict() for r in entry.queries()["pipeline"](spark, sf_dir).collect()]
    profiles = language_id.fit(spark.read.parquet(f"{sf_dir}/documents.parquet").where(~language_id.held_out()))
    model = language_id.Profiles(profiles)
    known = {i: r.text for i, r in rows.items() if (p := model.predict(r.text))[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE}
    groups = brute.ngram_links(list(known.items()), corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.ALIKE_PERCENT)
    distinct = {i: t for i, t in known.items() if groups[i][1] == i}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute.contamination(list(distinct.items()), items)
    clean = {}
    for i, t in distinct.items():
        if not hits[i][4]:
            secrets = [("secret", *m.span(1)) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)]
            for kind, s, e in sorted(brute.base_spans(t) + secrets, key=lambda x: -x[1]):
                t = f"{t[:s]}<{kind.upper()}>{t[e:]}"
            clean[i] = t
    assert {p["doc_id"] for p in found} == set(clean)
    assert brute.check_packing(list(clean.items()), found, Tokenizer.from_file(tokens.WORD_BPE)) == 0


def test_a_kept_text_travels_once(spark):
    """A text that is among the kept columns isn't sent beside them as well."""
    docs = spark.createDataFrame([(i, None if i == 700 else f"text {i}", "x") for i in range(1300)], "doc_id int, text string, lang string").repartition(2)

    def made(texts):
        yield None, {"n": [-1 if t is None else len(t) for t in texts]}
        yield [0], {"n": [-2]}

    for keep in (["doc_id"], ["doc_id", "text", "lang"], ["text"]):
        found = rows.map_texts(docs, "text", made, {"n": "bigint"}, iter(keep))
        plan = found._jdf.queryExecution().analyzed().toString()
        assert (" AS text" in plan) == ("text" not in keep)
        got = found.where("n > -2").select("row.*", "n").collect()
        assert len(got) == 1300 and sum(r["n"] for r in got) == sum(len(f"text {i}") for i in range(1300) if i != 700) - 1
        if "text" in keep:
            assert all(r["n"] == (-1 if r["text"] is None else len(r["text"])) for r in got)


def test_the_letter_tables_are_made_without_a_list_of_all_characters():
    """Each worker makes them as its first task begins; a list of all characters took some 80 MB in every one."""
    tracemalloc.start()
    letter, lower = language_id._letters.__wrapped__()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000
    assert len(letter) == len(lower) == 0x110000 and letter.dtype == bool and lower.dtype == "uint32"
    assert all(letter[ord(c)] == c.isalpha() and chr(lower[ord(c)]) == (c.lower() if len(c.lower()) == 1 else c) for c in "aZ1 İßΣ漢🎉")
