"""Text functions on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from chatloom.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "noise"),
    [("", True), ("️", True), ("‍", True), ("\U0001f3fb", True), ("️‍", True), ("❤", False), ("❤️", False), ("🤷‍♂", False), ("👍", False)],
)
def test_emoji_noise(spark, text, noise):
    assert value(spark, X.is_emoji_noise(F.lit(text))) is noise


@pytest.mark.parametrize(
    ("a", "b", "repeat"),
    [("рот", "че ты не понял, закрой уже свой рот", False), ("не поня", "не понял", True), ("Не понял!", "не понял", True), ("🥺", "🥺", True), ("🥺", "🙂", False), ("ок", "", False), (" ", "", True)],
)
def test_is_repeat(spark, a, b, repeat):
    assert value(spark, X.is_repeat(F.lit(a), F.lit(b))) is repeat


@pytest.mark.parametrize(
    ("reply", "lines"),
    [
        ('{"messages":["не поня\\n🥰","ок"]}', ["не поня", "🥰", "ок"]),
        ("просто текст", ["просто текст"]),
        ('{"messages":["1","2","3","4","5","6","7","8"]}', ["1", "2", "3", "4", "5", "6"]),
        ("  ", []),
        ('{"messages":[" "]}', ['{"messages":[" "]}']),
    ],
)
def test_parse_reply(spark, reply, lines):
    assert value(spark, X.parse_reply_messages(F.lit(reply))) == lines


def test_normalise(spark):
    cases = {
        "ПрИвЕт  😂 Мир\n": ("привет мир", "ru", 2),
        "Hello мир 1": ("hello мир 1", "mixed", 3),
        "😂😂": ("", None, 0),
        "123 ...": ("123 ...", None, 2),
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    n = X.normalize_text(F.col("t"))
    got = {r.t: (r.n, r.l, r.c) for r in rows.select("t", n.alias("n"), X.detect_language(n).alias("l"), X.count_tokens(n).alias("c")).collect()}
    assert got == cases


def test_skip_embedding(spark):
    rows = spark.createDataFrame([("один два три", ""), ("один два", ""), ("один два три", "voice"), ("", ""), (None, None)], "t string, k string")
    assert [r[0] for r in rows.select(X.skip_embedding(F.col("t"), F.col("k"))).collect()] == [False, True, True, True, True]


def test_signals_of_one_text(spark):
    t = F.lit("Ааааа!!! что?.. НУ ну, ок ....")
    assert value(spark, X.repeated_chars(t)) == {"а": 4}
    assert value(spark, X.punctuation_counts(t)) == {"!!!": 1, "!!": 1, "..": 3, "...": 1}
    assert value(spark, X.slang_markers(t)) == ["ну", "ок"]
    assert value(spark, X.repeated_chars(F.lit("ааа б аааааа"))) == {"а": 6}


@pytest.mark.parametrize(("text", "kind"), [("ПРИВЕТ", "all_caps"), ("привет", "lower"), ("Привет", "sentence"), ("ПРИвет", "mixed"), ("пРивет", "mixed"), ("123", None), ("Я", "all_caps")])
def test_capitalization(spark, text, kind):
    assert value(spark, X.capitalization(F.lit(text))) == kind


@pytest.mark.parametrize(("text", "only"), [(" ", True), ("", False), ("😂 ❤️", True), ("😂a", False), ("😂\n", False)])
def test_emoji_only(spark, text, only):
    assert value(spark, X.is_emoji_only(F.lit(text))) is only


def test_small_ones(spark):
    assert value(spark, X.trigram_similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(4 / 11)
    assert value(spark, X.trigram_similarity(F.lit(""), F.lit("!"))) == 0.0
    assert value(spark, X.preview(F.lit("abcdef"), 3)) == "abc…"
    assert value(spark, X.preview(F.lit("abc"), 3)) == "abc"
    assert value(spark, X.length_sigmoid(F.lit(30))) == 0.75
    assert value(spark, X.length_sigmoid(F.lit(0))) == 0.0
    assert value(spark, X.length_class(F.lit("a b c d"))) == "very_short"
    assert value(spark, X.tokenize(F.lit("Ой, 2х2=4!"))) == ["ой", "2х2", "4"]
    assert value(spark, X.episode_line(F.lit(True), F.lit("sticker"), F.lit("👍"), F.lit(""))) == "→ [👍]"
    assert value(spark, X.episode_line(F.lit(False), F.lit("sticker"), F.lit(None), F.lit(""))) == "← [sticker]"
    assert value(spark, X.episode_line(F.lit(False), F.lit("voice"), F.lit(None), F.lit("x"))) == "← [voice]"
    assert value(spark, X.episode_line(F.lit(False), F.lit(""), F.lit(None), F.lit(" "))) is None
    assert value(spark, X.sticker_emoticon(F.lit('{"SetName":"a","Emoticon":"👍"}'))) == "👍"
    assert value(spark, X.cosine_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(1 - 0.5**0.5)


def test_shorter_classes_hold_the_same_characters(spark):
    points = spark.range(1, 0x110000).where("id < 55296 or id > 57343").selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c")
    c = F.col("c")
    pairs = [
        (X._EMOJI_OR_JOINER, f"[{X.EMOJI_BLOCKS}{X.JOINERS}]"),
        (X._STRIPPED, rf"[{X.EMOJI_BLOCKS}\x{{200D}}\x{{FE00}}-\x{{FE0F}}]"),
        (X._WHITE, f"[{X.WHITE}]"),
        (X._CYRILLIC, r"\p{IsCyrillic}"),
    ]
    seen = points.agg(*[F.count_if(c.rlike(a) != c.rlike(b)) for a, b in pairs], *[F.count_if(c.rlike(a)) for a, _ in pairs]).first()
    assert seen[:4] == (0, 0, 0, 0) and min(seen[4:]) > 0


def test_layers_read_each_text_once(spark):
    from chatloom.operators import layers

    rows = [(1, "ха   Ха!!! ок", ""), (2, " 　 ", ""), (3, None, "voice"), (4, "...ок,. ну... 😂аааа аааб", None), (5, ".,! one  two three", "")]
    df = spark.createDataFrame(rows, "id long, text string, media_kind string")
    made = layers.build_semantic(df)
    assert "split(" not in made._jdf.queryExecution().optimizedPlan().toString()  # tokens are counted in the collapsed text
    t = F.col("normalized_text")
    kinds = df.select(F.col("id").alias("message_id"), "media_kind")
    want = made.join(kinds, "message_id").select("message_id", X.count_tokens(t), X.skip_embedding(t, F.col("media_kind"))).orderBy(F.col("message_id")).collect()
    assert [tuple(r) for r in made.select("message_id", "token_count", "skip_embedding").orderBy("message_id").collect()] == [tuple(r) for r in want]
    slang = {r.message_id: r.value_json for r in layers.extract_signals(df).where("signal_type = 'slang_markers'").collect()}
    assert slang == {1: '["ок"]', 4: '["ок","ну"]'}


def test_signals_test_cheaply_before_they_count(spark):
    """What has none of a signal's signs is not cut or counted, with the results of the plain definition."""
    texts = ["", None, " ", "Ab", "aB", "ABc", "AbC def", "Ǆǅ", "1Abc", "中A", "a!", "!.", "a!!b", "..?", "Ok", "ОК, ну", "лол", "x кек.", "но", "ß", "ÀÉ", "Ab\nCd", "hello world"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plans = {n: df.select(c)._jdf.queryExecution().optimizedPlan().toString() for n, c in {"marks": X.punctuation_counts(F.col("text")), "slang": X.slang_markers(F.col("text")), "caps": X.capitalization(F.col("text"))}.items()}
    assert all("RLIKE(text" in p.split(" THEN ", 1)[0] for p in plans.values())
    count = lambda cat: F.length(F.regexp_replace("text", rf"[^\p{{{cat}}}]+", ""))
    first = F.regexp_extract("text", r"\p{L}", 0).rlike(r"\p{Lu}")
    caps = F.when(count("L") == 0, None).when(count("Lu") == count("L"), "all_caps").when(count("Lu") == 0, "lower").when(first & (count("Ll") > count("Lu")), "sentence").otherwise("mixed")
    for r in df.select("text", caps.alias("want"), X.capitalization(F.col("text")).alias("got"), X.punctuation_counts(F.col("text")).alias("marks"), X.slang_markers(F.col("text")).alias("slang")).collect():
        assert r.got == r.want, r
        assert r.marks == {p: r.text.count(p) for p in X.EMPHASIS if p in r.text} if r.text else r.marks == {}
        assert r.slang == (None if r.text is None else [w for w in dict.fromkeys(w.strip(".,!?;:") for w in r.text.lower().split()) if w in X.SLANG])
