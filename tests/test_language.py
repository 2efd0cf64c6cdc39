"""The gate scored inside the row against the join of grams and profiles."""

from pyspark.sql import functions as F

from quillmere.operators import language

ROWS = [
    (1, "en", "the cat and the dog"), (2, "en", "that thing there"), (3, "fr", "le chat et les élèves"), (4, "fr", "où est la bibliothèque"),
    (5, None, None), (6, None, ""), (7, None, "short"), (8, None, "12345 67890 !!"), (9, None, "日本語のテキスト"), (10, None, "THE CHAT there"),
    (10, None, "le les la"),
]


def test_row_scoring_equals_the_join(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "id long, lang string, text string").repartition(3)
    profiles = language.train_language_profiles(df.filter("lang IS NOT NULL"), "text", "lang")
    one = df.filter("NOT (id = 10 AND text LIKE 'le%')")
    inside = language.language_gate(one, "id", "text", profiles)
    exchanges = [d._jdf.queryExecution().executedPlan().toString().count("Exchange") for d in (inside, one)]
    assert exchanges[0] == exchanges[1]
    got = {r["id"]: (r["detected"], r["passes"]) for r in inside.collect()}
    monkeypatch.setattr(language, "PROFILE_GRAMS", 0)
    joined = language.language_gate(one, "id", "text", profiles)
    assert {r["id"]: (r["detected"], r["passes"]) for r in joined.collect()} == got
    assert got[1] == ("en", True) and got[3] == ("fr", False) and got[5] == (None, True) and got[8] == (None, True)


def test_repeated_keys_keep_their_own_text(spark):
    df = spark.createDataFrame(ROWS, "id long, lang string, text string")
    profiles = language.train_language_profiles(df.filter("lang IS NOT NULL"), "text", "lang")
    got = language.language_gate(df, "id", "text", profiles).filter("id = 10").select("text", "detected").collect()
    assert {r["text"]: r["detected"] for r in got}["le les la"] == "fr" and len(got) == 2
    nothing = profiles.filter(F.lit(False))
    assert language.language_gate(df, "id", "text", nothing).filter("NOT passes").count() == 0


def test_rows_scored_together_get_their_own_language(spark, monkeypatch):
    monkeypatch.setattr(language, "ROWS_SCORED", 3)
    rows = [(i, lang, text) for i, (_, lang, text) in enumerate(ROWS * 4)]
    df = spark.createDataFrame(rows, "id long, lang string, text string").coalesce(1)
    profiles = language.train_language_profiles(df.filter("lang IS NOT NULL"), "text", "lang")
    got = {r["id"]: r["detected"] for r in language.language_gate(df, "id", "text", profiles).collect()}
    want = {r["id"]: r["detected"] for r in language.detect_language(df, "id", "text", profiles).collect()}
    assert got == {i: want.get(i) for i, _, _ in rows} and set(got.values()) == {"en", "fr", None}
