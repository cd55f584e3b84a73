"""Each operator and stage on awkward rows, on an empty table and with columns of clashing names."""

import zlib

import pytest
from awkward_inputs import SF, awkward  # noqa: F401

import corpus_pipeline
from tidewarden.llm import (codes, exact, html, language, neardup, packing, pivots, quality, rules, sentencepieces, spelling,
                            tokencounts, urls)


def labels_of(spark, docs):
    return docs.selectExpr("doc_id", "cast(pmod(doc_id, 2) AS int) AS quality", "0 AS toxic")


OPERATORS = {
    "tokencounts": tokencounts.section_tokens,
    "neardup": neardup.near_duplicates,
    "sentencepieces": sentencepieces.encode,
    "exact": exact.exact_groups,
    "exact_all": lambda d: exact.exact_groups(d, digest_all=True),
    "packing": packing.pack,
    "language": lambda d: language.predict(d, language.learn(d, d["doc_id"].isNotNull())),
    "rules": lambda d: rules.judge(d, labels_of(d.sparkSession, d)),
    "quality": lambda d: quality.predict(d, quality.learn(d, labels_of(d.sparkSession, d), d["doc_id"].isNotNull())),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, awkward, name):
    rows = OPERATORS[name](awkward).collect()
    per_id = {}
    for r in rows:
        per_id.setdefault(r["doc_id"], []).append(r)
    assert set(per_id) == {None, *range(1, 13)}
    if name not in ("tokencounts", "packing"):
        assert {k: len(v) for k, v in per_id.items() if len(v) > 1} == {7: 2, 12: 2}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, awkward, name):
    assert OPERATORS[name](awkward.where("false")).collect() == []


def test_no_model_without_rows(spark, awkward):
    none = awkward.where("false")
    assert language.learn(none, none["doc_id"].isNotNull()) is None
    got = language.predict(awkward, None).select("language.*").distinct().collect()
    assert [tuple(r) for r in got] == [("und", 0.0, True)]
    assert quality.learn(none, labels_of(spark, none), none["doc_id"].isNotNull()) is None
    assert [r[0] for r in quality.predict(awkward, None).select("quality.score").distinct().collect()] == [0.5]


def test_texts_without_letters_have_no_language(spark, awkward):
    rows = language.predict(awkward, language.learn(awkward, awkward["doc_id"].isNotNull())).collect()
    none = {r["doc_id"] for r in rows if r["language"]["lang_pred"] == "und"}
    assert none == {1, 2, 3, 8}


def test_awkward_pages(spark):
    page = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", ""), (None, "u", "<article><p>a &amp; b"), (3, "u", "plain"),
                                  (4, "u", "<div>" * 5000 + "deep"), (5, "u", "<article><p>" + "word " * 100_000)],
                                 "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars", "2 AS _id")
    rows = html.extract(page).collect()
    assert sorted((r[0] or 0, r[3]) for r in rows)[:4] == [(0, 5), (1, 0), (2, 0), (2, 0)]
    assert {r[0]: r[3] for r in rows}[5] == 499_999
    assert html.extract(page.where("false")).collect() == []
    rules = spark.createDataFrame([("org", "/", "allow")], "host string, path string, verdict string")
    assert len(urls.judge(page, rules).collect()) == 7
    assert urls.judge(page.where("false"), rules).collect() == []
    assert {r["verdict"] for r in urls.judge(page, rules.where("false")).collect()} == {"allow"}


def test_awkward_vectors(spark):
    nan = float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1e200, 1e200]), (7, [1.0, 1.0]),
            (7, [1.0, 1.0]), (8, [-0.0, 2.0]), (9, [0.0, 2.0]), (10, [1.0, 1.0, 1.0]), (None, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS n_links", "1 AS vid", "2 AS unit")
    got = sorted(((r[0] or 0, r[1], r[2]) for r in pivots.near_vectors(df).collect()))
    assert got == [(0, 3, 6), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 3, 6), (7, 3, 6), (7, 3, 6),
                   (8, 1, 8), (9, 1, 8), (10, 0, 10)]
    assert pivots.near_vectors(df.where("false")).collect() == []


def test_stages_bear_awkward_rows(spark, awkward):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (awkward, awkward.where("false")):
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, awkward.where("false"), SF).collect() == []


def test_stages_keep_one_row_where_ids_repeat(spark):
    words = [f"w{i}" for i in range(200)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(reversed(words))
    rows = [(1, text), (1, text), (2, near), (2, other), (2, other), (3, "lone words"), (3, near + " y"), (None, "no id"), (None, "no id"),
            (4, ""), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _sha")
    stages = dict(corpus_pipeline.STAGES)
    once = stages["exact dedup"](spark, docs, SF)
    assert once.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in once.collect()]
    assert len(got) == len(set(got)) and set(got) == set(rows)
    kept = [(r["doc_id"], r["text"]) for r in stages["MinHash near-dedup"](spark, once, SF).collect()]
    assert sorted(kept, key=str) == sorted([(1, text), (2, other), (3, "lone words"), (None, "no id"), (4, "")], key=str)
    twice = spark.createDataFrame([(5, text), (5, near)], "doc_id long, text string")
    assert stages["MinHash near-dedup"](spark, twice, SF).count() == 1


def test_samples_are_bounded_where_ids_repeat(spark, monkeypatch):
    docs = spark.range(300).selectExpr("if(id < 200, 0, id) AS doc_id", "concat('some words ', id) AS text", "'en' AS lang")
    seen = []
    for module in (language, quality):
        real = module.fit
        monkeypatch.setattr(module, "fit", lambda x, *rest, real=real: seen.append(len(x)) or real(x, *rest))
    language.learn(docs, docs["doc_id"].isNotNull(), most=101)
    quality.learn(docs, labels_of(spark, docs.select("doc_id").distinct()), docs["doc_id"].isNotNull(), most=51)
    assert seen == [101, 101]   # the ids: 0 and 200 to 299


def test_spelling_of_awkward_rows(spark, awkward):
    whole = [[i for i in range(4, 99) if zlib.crc32(f"{i}:{w}".encode()) % 31][:2] for w in ("x" * 200_000, "x" * 199_999 + "y")]
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 34"), (None, "Schwarz schwarzer"), (None, "SCHWARZ schwarz schwarzer"),
                                  *[(i, "x" * 200_000) for i in whole[0]], *[(i, "x" * 199_999 + "y") for i in whole[1]]],
                                 "doc_id long, text string").selectExpr("*", "'a' AS word", "1 AS n", "'b' AS form", "'c' AS _run", "2 AS _h")
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["root"] == r["word"]) for r in spelling.variants(docs).collect()}
    assert got == {"schwarz": (3, 0, None, True), "schwarzer": (2, 0, None, True), "x" * 200_000: (2, 1, None, True),
                   "x" * 199_999 + "y": (2, 1, None, True)}
    assert spelling.variants(docs.where("false")).collect() == []
    assert {r["word"] for r in spelling.variants(awkward).collect()} <= {"straße"}   # ids of 7 letters there: none twice


def test_codes_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    ok = [float(k) / 7 for k in range(16)]
    rows = [(1, None, 1), (2, [], 1), (3, ok[:8], 1), (4, [None, *ok[1:]], 1), (5, [nan, *ok[1:]], 1), (6, [*ok[1:], inf], 1), (7, [1e200, *ok[1:]], 1),
            (0, ok, 1), (8, [-x for x in ok], None), (8, ok, None), (8, ok, 2), (None, ok, 2), (9, ok[:7], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr(
        "*", "'x' AS code", "1 AS id", "2 AS error", "3 AS distance", "4 AS sums")
    got = sorted(((-1 if r[0] is None else r[0], r[1], r[2], r[3]) for r in codes.coded(df).collect()))
    # the codebooks start as the kept vectors by id: 0; three of id 8, the negated one last; the one without an id
    assert got == [(-1, "00" * 8, 0, 0), (0, "00" * 8, 0, 0), (8, "00" * 8, 0, 0), (8, "00" * 8, 0, 0), (8, "03" * 8, 0, 0)]
    assert codes.coded(df.where("false")).collect() == []
    assert codes.coded(df.where("vec_id < 3 AND vec_id > 0")).collect() == []


def test_rules_of_awkward_texts(spark):
    texts = [None, "", "   ", "a b c d e f g h i j", "one two three four five six seven eight nine", "a b c d e " * 4, "w\nw\n\n \n \nw x\nw x",
             "#*$%&|<> é\u00a0ü\x1f", " ".join(f"w{k}" for k in range(50_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("*", "1 AS counts", "2 AS id", "3 AS score")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r[0]: (*r[1:6], r["base_failed"], r["kept"]) for r in rules.judge(docs, none).collect()}
    assert got == {0: (0, 0, 0, 0, 0, True, False), 1: (0, 0, 0, 0, 0, True, False), 2: (0, 0, 0, 0, 0, True, False),
                   3: (10, 10, 0, 0, 0, False, True), 4: (9, 36, 0, 0, 0, True, False), 5: (20, 20, 0, 0, 20, True, False),
                   6: (6, 6, 0, 2, 0, True, False), 7: (2, 12, 8, 0, 0, True, False),
                   8: (50_000, len(texts[8].replace(" ", "")), 0, 0, 0, False, True)}
