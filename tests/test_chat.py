"""Chat operators against hand-written cases and plain sequential loops on random chats."""

import random
import re
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.operators import chats, episodes, layers, ordered, prompts, ranking, search, sessions, similarity, upsert, vectors, windows
from chatloom.sources import records

START = datetime(2026, 1, 15, 12, tzinfo=timezone.utc)
INPUT = "id long, telegram_id long, chat_id long, chat_title string, author_id long, sent_at timestamp, normalized_text string, token_count int, is_outgoing boolean, media_kind string"


def turn_rows(spark, rows):
    """(id, author, seconds, text, media)"""
    data = [(i, i, 100, "", a, START + timedelta(seconds=s), t, len(t.split()), False, k) for i, a, s, t, k in rows]
    return spark.createDataFrame(data, INPUT)


@pytest.mark.parametrize(
    ("rows", "gap", "expected"),
    [
        ([(1, 10, 0, "привет", ""), (2, 10, 30, "как дела", ""), (3, 10, 60, "что делаешь", "")], 120, [(1, 3, "привет как дела что делаешь", 0)]),
        ([(1, 10, 0, "вопрос", ""), (2, 20, 10, "ответ", ""), (3, 10, 20, "реакция", "")], 60, [(1, 1, "вопрос", 0), (2, 1, "ответ", 0), (3, 1, "реакция", 0)]),
        ([(1, 10, 0, "a", ""), (2, 10, 120, "b", ""), (3, 10, 241, "c", "")], 120, [(1, 2, "a b", 0), (3, 1, "c", 0)]),
        ([(1, 10, 0, "", "sticker"), (2, 20, 10, "текст", "")], 60, [(2, 1, "текст", 0)]),
        ([(1, 10, 0, "смотри", ""), (2, 10, 10, "", "sticker"), (3, 10, 20, "смешно же", "")], 60, [(1, 3, "смотри смешно же", 0)]),
        ([(1, 10, 0, "text", ""), (2, 10, 10, "text", "voice")], 60, [(1, 2, "text text", 1)]),
        ([], 60, []),
    ],
)
def test_utterances(spark, rows, gap, expected):
    got = sessions.build_utterances(turn_rows(spark, rows), gap).orderBy("position").collect()
    assert [(r.first_message_id, r.message_count, r.text, r.voice_count) for r in got] == expected
    assert [r.position for r in got] == list(range(len(expected)))


def random_messages(spark, seed, n=240, chats_=3):
    """Chats over several days with replies, deletions and all kinds of pauses."""
    rng, rows, clock = random.Random(seed), [], dict.fromkeys(range(1, chats_ + 1), 0)
    numbers = dict.fromkeys(clock, 0)
    for i in range(1, n + 1):
        c = rng.randint(1, chats_)
        clock[c] += rng.choice([5, 60, 120, 121, 1300, 3700, 4 * 3600, 5 * 3600]) if rng.random() < 0.5 else rng.randint(1, 200)
        numbers[c] += 1
        reply = rng.randint(max(1, numbers[c] - 8), numbers[c] - 1) if numbers[c] > 1 and rng.random() < 0.4 else None
        rows.append((i, numbers[c], c, rng.choice([None, 1, 2, 3]), reply, rng.choice(["а", "б в", ""]), START + timedelta(seconds=clock[c]), rng.random() < 0.3, rng.random() < 0.1, rng.random() < 0.7))
    schema = "id long, telegram_id long, chat_id long, sender_id long, reply_to_id long, text string, sent_at timestamp, is_outgoing boolean, is_deleted boolean, in_memory_window boolean"
    return spark.createDataFrame(rows, schema), rows


def plain_segments(rows, c):
    """One chat's segments: (first row, rows, method, confidence)."""
    segs = []
    for i, r in enumerate(rows):
        if i == 0:
            segs.append([[r], "initial", np.float32(1)])
            continue
        gap = (r[6] - rows[i - 1][6]).total_seconds()
        tier = 3 if gap >= c.hard_gap else 2 if gap >= c.medium_gap else 1 if gap >= c.soft_gap else 0
        inside = r[4] is not None and any(x[1] == r[4] for x in segs[-1][0])
        score, method = episodes.boundary_score(tier, r[6].date() != rows[i - 1][6].date(), inside, c), ("", "time_gap_soft", "time_gap_medium", "time_gap_hard")[tier]
        if len(segs[-1][0]) >= c.max_size:
            score, method = np.float32(1), "size_limit"
        if score >= np.float32(c.threshold):
            segs.append([[r], method, score])
        else:
            segs[-1][0].append(r)
    out = []
    for s in segs:
        if len(s[0]) < c.min_size and out:
            out[-1][0] += s[0]
        else:
            out.append(s)
    return [(s[0][0][0], len(s[0]), s[1], round(float(s[2]), 5)) for s in out]


@pytest.mark.parametrize("block", [1 << 16, 7, 1])
@pytest.mark.parametrize(("seed", "config"), [(1, episodes.Config()), (2, episodes.Config(max_size=5)), (3, episodes.Config(max_size=3, reply_bonus=0.6))])
def test_episodes_against_a_loop(spark, monkeypatch, seed, config, block):
    monkeypatch.setattr(episodes, "BLOCK", block)
    df, rows = random_messages(spark, seed)
    expected = sorted(x for c in (1, 2, 3) for x in plain_segments([r for r in rows if r[2] == c], config))
    segmented = episodes.segment_episodes(df, config).cache()
    e = episodes.build_episodes(segmented)
    assert sorted((r.episode_id, r.message_count, r.segmented_by, round(r.confidence, 5)) for r in e.collect()) == expected
    links = episodes.episode_links(segmented).collect()
    assert sorted(r.message_id for r in links) == [r[0] for r in rows]
    assert min(r.position for r in links) == 0


def test_windows_against_a_loop(spark):
    df, rows = random_messages(spark, 5)
    scored = spark.createDataFrame([(1, "social"), (2, "passive_consumption"), (3, "interpersonal")], "id long, personality_surface string")
    got = {r.id: r.in_memory_window for r in windows.participation_windows(df, scored, before=3, after=1).collect()}
    expected = {r[0]: r[9] for r in rows}
    for c in (1, 2):
        live = [r for r in rows if r[2] == c and not r[8]]
        targets = {r[4] for r in live if r[7]}
        for i, r in enumerate(live):
            expected[r[0]] = any(x[7] for x in live[max(0, i - 1) : i + 4]) or r[1] in targets
    assert got == expected


def test_order_does_not_depend_on_buckets_or_partitions(spark, monkeypatch):
    df, _ = random_messages(spark, 9)
    expected = None
    for span, parts in ((ordered.DAY_US, "4"), (60_000_000, "1"), (1 << 60, "17")):
        monkeypatch.setattr(ordered.bucketed, "__defaults__", ("sent_at", span))
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = ordered.with_last_seen(ordered.with_previous(ordered.with_row_number(df.orderBy(F.rand(3)), "n"), {"p": F.col("id")}), F.when(F.col("is_outgoing"), F.col("id")), "l")
        got = sorted((r.id, r.n, r.p, r.l) for r in rows.collect())
        expected = expected or got
        assert got == expected
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_near_flag_blocks(spark):
    df, _ = random_messages(spark, 11)
    numbered = ordered.with_row_number(df, "n").cache()
    got = [sorted((r.id, r.f) for r in ordered.near_flag(numbered, F.col("is_outgoing"), 2, 3, "f", "n", block=b).collect()) for b in (5, 100_000)]
    assert got[0] == got[1]


@pytest.mark.parametrize(
    ("kind", "flags", "score", "surface", "sync"),
    [
        ("saved_messages", "", 1.00, "self_expression", True), ("private", "", 0.85, "interpersonal", True), ("private", "b", 0.50, "tool_interaction", True),
        ("channel", "c", 0.90, "self_expression", True), ("channel", "", 0.10, "passive_consumption", False), ("group", "", 0.60, "social", True), ("group", "c", 0.80, "social", True),
        ("supergroup", "", 0.55, "social", True), ("carrier_pigeon", "", 0.00, "passive_consumption", False), ("group", "a", 0.70, "social", True),
        ("supergroup", "ca", 0.75, "social", True), ("supergroup", "a", 0.65, "social", True), ("channel", "a", 0.75, "self_expression", True),
    ],
)
def test_score_chats(spark, kind, flags, score, surface, sync):
    df = spark.createDataFrame([(1, kind, "b" in flags, "c" in flags, "a" in flags)], "id long, type string, is_bot boolean, is_creator boolean, is_admin boolean")
    scored = chats.score_chats(df)
    r = scored.first()
    assert (round(r.relevance_score, 2), r.personality_surface) == (score, surface) and r.relevance_reason.strip()
    assert (chats.chats_to_sync(scored).count() == 1) is sync


def hits(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "query_id long, first_message_id long, score double")


def test_hybrid(spark):
    out = ranking.with_rank(ranking.hybrid_rrf(hits(spark, [(1, 99999.0), (2, 88888.0)]), hits(spark, [(2, 0.71), (3, 0.69)]))).orderBy("rank").collect()
    assert [r.first_message_id for r in out] == [2, 1, 3] and out[0].score == pytest.approx(1 / 62 + 1 / 61)
    out = ranking.with_rank(ranking.hybrid_rrf(hits(spark, [(7, 1.0)]), hits(spark, [(3, 1.0)]))).orderBy("rank").collect()
    assert [r.first_message_id for r in out] == [3, 7]
    assert ranking.hybrid_rrf(hits(spark, []), hits(spark, [])).count() == 0


def test_retrieve_refuses_blank_queries(spark):
    with pytest.raises(ValueError):
        ranking.retrieve(spark.createDataFrame([(1, " ")], "query_id long, query string"), hits(spark, []))


def test_memories(spark):
    rows = [(1, i, i, i % 3 != 0, "a b c d" if i % 2 else "a b") for i in range(1, 31)]
    df = spark.createDataFrame(rows, "query_id long, first_message_id long, rank int, is_outgoing boolean, text string")
    assert [r["rank"] for r in ranking.select_memories(df).orderBy("rank").collect()] == [1, 5, 7, 11, 13]


def test_drop_repeats(spark):
    schema = "query string, history array<struct<from_persona:boolean,text:string>>, messages array<string>"
    rows = [
        ("вопрос", [], ["не понял", "ага", "Не понял!", "ага 🥰"]),
        ("вопрос", [(True, "не понял"), (True, "🥺")], ["не поня", "🥺", "да нормально всё"]),
        ("тот же вопрос", [(False, "ага")], ["Тот же вопрос?", "ага"]),
    ]
    got = [r.kept for r in prompts.drop_repeats(spark.createDataFrame(rows, schema)).collect()]
    assert got == [["не понял", "ага"], ["да нормально всё"], ["ага"]]


def plain_rank(tokens, must, weight=0.1):
    """Cover density step by step: the next stretch that meets every part, cut at its front, and on from there."""
    words = {w for part in must for alt in part for w in alt}
    spots = [(i, t) for i, t in enumerate(tokens, 1) if t in words]
    met = lambda seen: all(any(set(alt) <= seen for alt in part) for part in must)
    total = near = n = at = 0
    before = None
    while ends := [j for j in range(at, len(spots)) if met({t for _, t in spots[at : j + 1]})]:
        end = ends[0]
        begin = max(b for b in range(at, end + 1) if met({t for _, t in spots[b : end + 1]}))
        p, q = spots[begin][0], spots[end][0]
        total += weight / (1 + max(0, q - p - (end - begin)))
        if before is not None and (p + q) / 2 > before:
            near += 1 / ((p + q) / 2 - before)
        before, n, at = (p + q) / 2, n + 1, begin + 1
    return total / (n / near) if near else total


def test_queries_are_parsed(spark):
    asked = search.as_table(spark, [(1, 'a "b c" or d -e -"f g"'), (2, "or x -or or --y"), (3, " - "), (4, None), (5, '"or" OR "z')])
    got = [tuple(r) for r in search.parse_queries(asked).orderBy("query_id", "alt").collect()]
    assert got == [
        (1, 0, 1, False, ["a"]), (1, 1, 2, False, ["b", "c"]), (1, 2, 2, False, ["d"]), (1, 3, 0, True, ["e"]), (1, 4, 0, True, ["f", "g"]),
        (2, 0, 1, False, ["x"]), (2, 1, 0, True, ["or"]), (2, 2, 0, True, ["y"]), (5, 0, 1, False, ["or"]), (5, 1, 1, False, ["z"]),
    ]


def test_full_text(spark):
    texts = ["x a b", "b a", "a e", "", None, "a x a a", "a x b", "b c a d", "d a c b", "A a B b c c a b d x x x d a", "a b c " * 7, "e f g a d"]
    must = {1: ([[["a"]]], []), 2: ([[["a", "b"]]], []), 3: ([[["a"]]], ["e"]), 4: ([[["b"], ["e"]]], []), 5: ([[["zz"]]], []), 6: ([[["a"]], [["b", "c"], ["d"]]], ["e"]), 7: ([[["a"]], [["a"]]], [])}
    asked = [(1, "a"), (2, '"a b"'), (3, "a -e"), (4, "b or e"), (5, "zz"), (6, 'a "b c" or d -e'), (7, "a a"), (8, "-a"), (9, "")]
    got = {(r.query_id, r.id): r["rank"] for r in search.full_text(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), search.as_table(spark, asked), "id", "text").collect()}
    expected = {}
    for q, (parts, never) in must.items():
        for i, text in enumerate(texts):
            tokens = (text or "").lower().split()
            run = lambda alt, t=tokens: any(t[k : k + len(alt)] == alt for k in range(len(t)))
            if tokens and all(any(run(alt) for alt in part) for part in parts) and not set(never) & set(tokens):
                expected[q, i] = pytest.approx(plain_rank(tokens, parts), abs=1e-8)
    assert got == expected
    assert got[1, 0] == 0.1 and got[1, 5] == pytest.approx(0.1 * (1 / 2 + 1)) and (2, 6) not in got


def test_most_similar(spark):
    words = ["the", "then", "other", "mother", "ünïcode", "x", "alpha beta", "𝔘𝔫𝔦", "12 34"]
    texts = [" ".join(words[(i * k) % len(words)] for k in range(1, 2 + i % 7)) for i in range(60)] + ["", "?!", "the then other"]
    rows = spark.createDataFrame([(i, i % 5, t) for i, t in enumerate(texts)], "id long, newer long, text string")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if i % 4 == 0] + [(99, None), (98, "zz qq")], "query_id long, query string")

    def grams(t):
        return {p[k : k + 3] for w in re.findall(r"[^\W_]+", t.lower()) for p in ["  " + w + " "] for k in range(len(p) - 2)}

    for other in (False, True):
        got = sorted((r.query_id, r.id, round(r["rank"], 9)) for r in search._best(similarity.most_similar(rows, asked, 0.4, 5, other), 5, "newer", "id").collect())
        expected = []
        for q in asked.collect():
            g = grams(q.query or "")
            near = sorted((-len(g & grams(t)) / len(g | grams(t)), -(i % 5), i) for i, t in enumerate(texts) if g and grams(t) and len(g & grams(t)) >= 0.4 * len(g | grams(t)) and not (other and t == q.query))
            expected += [(q.query_id, i, round(-s, 9)) for s, _, i in near[:5]]
        assert got == sorted(expected)


def test_upserts_are_idempotent(spark):
    base = spark.createDataFrame([(1, 1, "old", 5), (1, None, "null key", 6)], "chat_id long, telegram_id long, text string, sender_id long")
    new = spark.createDataFrame([(1, 1, "new", 9), (1, 2, "more", 8), (1, None, "again", 7)], base.schema)
    once = upsert.upsert(base, new, ["chat_id", "telegram_id"], ["text"])
    twice = upsert.upsert(once, new, ["chat_id", "telegram_id"], ["text"])
    expected = [(1, 1, "new", 5), (1, 2, "more", 8), (1, None, "again", 6)]
    for df in (once, twice):
        assert sorted(map(tuple, df.collect()), key=str) == sorted(expected, key=str)
    assert sorted(map(tuple, upsert.insert_if_absent(base, new, ["chat_id", "telegram_id"]).collect()), key=str) == sorted([*map(tuple, base.collect()), (1, 2, "more", 8)], key=str)


def test_transcripts_stay(spark):
    schema = "message_id long, normalized_text string, language string, token_count int, skip_embedding boolean, transcribed_at timestamp"
    base = spark.createDataFrame([(1, "said", None, 1, True, START), (2, "", None, 0, True, None)], schema)
    new = spark.createDataFrame([(1, "", None, 0, True, None), (2, "x", "en", 1, True, None)], schema)
    assert sorted((r.message_id, r.normalized_text) for r in upsert.upsert_semantic(base, new).collect()) == [(1, "said"), (2, "x")]
    t = spark.createDataFrame([(1, "other", START), (2, None, START)], "message_id long, transcript string, done_at timestamp")
    done = {r.message_id: r for r in layers.apply_transcripts(base, t).collect()}
    assert done[1].normalized_text == "said" and done[2].normalized_text == "" and done[2].transcribed_at is not None


def test_embed_and_gap_check(spark):
    utts = spark.createDataFrame([(1, "x" * 50), (2, "short"), (3, "y" * 60)], "first_message_id long, text string")
    store = spark.createDataFrame([], "first_message_id long, model_name string, gap_seconds int, embedded_at timestamp, vector array<float>, text_hash long")
    fake = lambda texts: [None if t[0] == "y" else [float(len(t))] for t in texts]
    once = vectors.embed_pending(utts, store, fake, "m", 120, F.lit(START))
    assert [(r.first_message_id, r.vector) for r in once.collect()] == [(1, [50.0])]
    assert [r[0] for r in vectors.pending_utterance_embeddings(utts, once, 120).select("first_message_id").collect()] == [3]
    changed = utts.withColumn("text", F.concat("text", F.lit("!")))
    assert sorted(r[0] for r in vectors.pending_utterance_embeddings(changed, once, 120, changed_too=True).select("first_message_id").collect()) == [1, 3]
    with pytest.raises(ValueError):
        vectors.pending_utterance_embeddings(utts, once, 60)


def test_raw_records(spark, tmp_path):
    good = '{"telegram_id":7,"chat_id":1,"sender_id":0,"text":"a","sent_at":100,"reactions":[{"Emoji":" ","Count":1},{"Emoji":"👍","Count":2}],"edit_date":0}'
    (tmp_path / "m.json").write_text(good + "\n{broken\n" + '{"text":"no key"}\n')
    rows = records.read_messages(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].sender_id is None and rows[0].edit_date is None and [x.Emoji for x in rows[0].reactions] == ["👍"]
    assert records.broken_records(spark, str(tmp_path)).count() == 2


def test_media_dialogs_and_senders(spark):
    attrs = "array<struct<kind:string,voice:boolean,round:boolean>>"
    rows = [("document", [("audio", False, None), ("audio", True, None)], "voice"), ("document", [("video", None, True)], "round"), ("document", [("video", None, False), ("sticker", None, None)], "video"),
            ("document", [("sticker", None, None)], "sticker"), ("document", None, "document"), ("photo", None, "photo"), ("geo_live", None, "geo"), ("invoice", None, "document"), (None, None, "")]
    df = spark.createDataFrame(rows, f"media string, a {attrs}, kind string")
    assert df.where(records.classify_media(F.col("media"), F.col("a")) != F.col("kind")).count() == 0
    peers = spark.createDataFrame(
        [("user", 1, True, "A", "B", None, "u", False, False, False, False), ("user", 2, False, "", None, None, "bot", True, False, False, False), ("chat", 3, False, None, None, "g", None, False, True, False, False), ("channel", 4, False, None, None, "s", "x", False, False, True, True), ("secret", 5, *[None] * 9)],
        "peer_kind string, id long, is_self boolean, first_name string, last_name string, title string, username string, bot boolean, creator boolean, admin_rights boolean, megagroup boolean",
    )
    got = [(r.id, r.type, r.title, r.is_bot, r.is_creator, r.is_admin) for r in records.classify_dialog(peers).orderBy("id").collect()]
    assert got == [(1, "saved_messages", "Saved Messages", False, False, False), (2, "private", "bot", True, False, False), (3, "group", "g", False, True, False), (4, "supergroup", "s", False, False, True)]
    sender = lambda *a: spark.range(1).select(records.resolve_sender(*[F.lit(x) for x in a])).first()[0]
    assert [sender(5, "user", 9, True, 1), sender(None, "user", 9, True, 1), sender(None, "user", 9, False, 1), sender(None, "channel", 9, False, 1)] == [5, 1, 9, None]


def test_layers_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i) for i in range(9)], "chat_id long, v long")
    records.write_layer(df, str(tmp_path / "l"))
    records.write_layer(df.where("chat_id = 1").withColumn("v", F.col("v") * 10), str(tmp_path / "l"))
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "l")).collect()) == [0, 2, 3, 5, 6, 8, 10, 40, 70]


def test_ranks_of_whole_lists(spark):
    rng = random.Random(8)
    rows = [(rng.randint(1, 3), i, rng.choice([rng.uniform(-2, 2), rng.choice([0.0, -0.0, 0.5, 1.0, -1.0]), rng.uniform(0, 1e-300), rng.uniform(0, 1e12)])) for i in range(900)]
    got = {(r.query_id, r.first_message_id): r["rank"] for r in ranking.with_rank(spark.createDataFrame(rows, "query_id long, first_message_id long, score double").repartition(5)).collect()}
    for q in (1, 2, 3):
        own = sorted((-s, i) for k, i, s in rows if k == q)
        assert [got[q, i] for _, i in own] == list(range(1, len(own) + 1))
