"""Scalar text functions as Columns: normalisation, classification and similarity of chat text.

Lengths count code points. Every function keeps null unless it says otherwise.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Emoji blocks, joiner and selector, white space, emphasis patterns, slang words.
EMOJI_BLOCKS = (
    r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}"
    r"\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{1F1E0}-\x{1F1FF}"
)
JOINERS = r"\x{200D}\x{FE0F}"
WHITE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# The same classes behind one range that most characters fail: a class of many ranges is slow for each character that it lacks.
_EMOJI_OR_JOINER = rf"[\x{{200D}}-\x{{1FAFF}}&&[{EMOJI_BLOCKS}{JOINERS}]]"
_STRIPPED = rf"[\x{{200D}}-\x{{1FAFF}}&&[{EMOJI_BLOCKS}\x{{200D}}\x{{FE00}}-\x{{FE0F}}]]"
_WHITE = rf"[\x{{9}}-\x{{20}}\x{{85}}\x{{A0}}\x{{1680}}-\x{{3000}}&&[{WHITE}]]"
_CYRILLIC = r"[\x{400}-\x{10FFFF}&&\p{IsCyrillic}]"
EMPHASIS = ("!!!", "!!", "...", "..", "?!", "!?", "???", "??")
SLANG = (
    "ахах хаха хахаха ахахах ок окей ок. ага угу ну да нет не лол кек ору норм нормально збс пон понял понятно "
    "кст кстати имхо имхо, щас сейчас ладн ладно"
).split()


def strip_emoji(x: Column) -> Column:
    """Each emoji, joiner or variation selector becomes a blank."""
    return F.regexp_replace(x, _STRIPPED, " ")


def collapse_whitespace(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, f"{_WHITE}+", " "))


def normalize_text(x: Column) -> Column:
    return collapse_whitespace(F.lower(strip_emoji(x)))


def words(x: Column) -> Column:
    """White-space fields."""
    return F.filter(F.split(x, f"{_WHITE}+"), lambda w: w != "")


def count_tokens(x: Column) -> Column:
    return F.coalesce(F.size(words(x)), F.lit(0))


def count_fields(x: Column) -> Column:
    """count_tokens of text whose white space is collapsed."""
    return F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1)


def detect_language(x: Column) -> Column:
    """ru, en or mixed by script of the (lower-cased) text; null if it has neither."""
    cyrillic, latin = x.rlike(_CYRILLIC), x.rlike("[a-z]")
    return F.when(cyrillic, F.when(latin, "mixed").otherwise("ru")).when(latin, "en")


def is_blank(x: Column) -> Column:
    return F.coalesce(~x.rlike(f"[^{WHITE}]"), F.lit(True))


def skip_embedding(text: Column, media_kind: Column) -> Column:
    """Whether the (normalised) text is not worth a vector: sticker, voice, round, blank or under 3 tokens."""
    return F.coalesce(media_kind.isin("sticker", "voice", "round"), F.lit(False)) | is_blank(text) | (count_tokens(text) < 3)


def collect_emoji(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(_EMOJI_OR_JOINER), 0)


def is_emoji_only(x: Column) -> Column:
    return F.coalesce(x.rlike(rf"\A[{EMOJI_BLOCKS}{JOINERS} ]+\z"), F.lit(False))


def punctuation_counts(x: Column) -> Column:
    """Map of emphasis pattern -> non-overlapping occurrences, patterns counted apart, zeros left out."""
    pairs = [F.struct(F.lit(p).alias("k"), ((F.length(x) - F.length(F.replace(x, F.lit(p), F.lit("")))) / len(p)).cast("int").alias("n")) for p in EMPHASIS]
    found = F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["n"] > 0))
    # each pattern has two of its signs in a row
    return F.when(x.rlike("[!?.][!?.]"), found).otherwise(F.create_map().cast("map<string,int>"))


def capitalization(x: Column) -> Column:
    """all_caps, lower, sentence or mixed by the letters; null without letters."""
    count = lambda cls: F.length(F.regexp_replace(x, f"[^{cls}]+", ""))
    only_upper, none_upper = ~x.rlike(r"[\p{L}&&[^\p{Lu}]]"), ~x.rlike(r"\p{Lu}")
    first = x.rlike(r"\A\P{L}*+\p{Lu}")
    # a lower letter after each upper one, and two after some: more lower than upper ones, without counting
    followed = x.rlike(r"\p{Lu}\p{Ll}\p{Ll}") & ~x.rlike(r"\p{Lu}(?!\p{Ll})")
    most_lower = F.when(followed, True).otherwise(count(r"\p{Ll}") > count(r"\p{Lu}"))
    kind = F.when(only_upper, "all_caps").when(none_upper, "lower").when(~first, "mixed").when(most_lower, "sentence").otherwise("mixed")
    return F.when(x.rlike(r"\p{L}"), kind).when(x.isNull(), "mixed")


def length_class(x: Column) -> Column:
    n = F.length(F.regexp_replace(F.coalesce(x, F.lit("")), f"{_WHITE}+", ""))
    return F.when(n < 5, "very_short").when(n <= 30, "short").when(n <= 150, "medium").otherwise("long")


def repeated_chars(x: Column) -> Column:
    """Map of letter -> length of its last run of three or more."""
    runs = F.regexp_extract_all(x, F.lit(r"((\p{L})\2{2,})"), 1)
    entries = F.transform(runs, lambda r, i: F.struct(F.substring(r, 1, 1).alias("k"), F.length(r).alias("n"), i.alias("i")))
    last = F.filter(entries, lambda e: ~F.exists(entries, lambda o: (o["k"] == e["k"]) & (o["i"] > e["i"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"].alias("k"), e["n"].alias("n"))))


@cache
def _begins(words: tuple[str, ...]) -> str:
    """A class of all characters whose lower case begins one of the words, behind one range as above."""
    firsts = {w[0] for w in words}
    found = [n for n in range(0x110000) if chr(n).lower()[0] in firsts]
    return rf"[\x{{{min(found):X}}}-\x{{{max(found):X}}}&&[" + "".join(rf"\x{{{n:X}}}" for n in found) + "]]"


def slang_markers(x: Column, known: list[str] | None = None) -> Column:
    """Known words, punctuation trimmed, each once in order of first use."""
    known = known or SLANG
    bare = F.transform(words(F.lower(x)), lambda w: F.btrim(w, F.lit(".,!?;:")))
    found = F.array_distinct(F.filter(bare, lambda w: w.isin(known)))
    if not all(known):  # the empty word has no first letter
        return found
    # a text without any word's first letter is not cut into words
    return F.when(x.rlike(_begins(tuple(known))), found).when(x.isNotNull(), F.array().cast("array<string>"))


def length_bucket(x: Column) -> Column:
    n = F.length(x)
    return F.when(n <= 10, "tiny").when(n <= 50, "short").when(n <= 200, "medium").when(n <= 500, "long").when(n > 500, "very_long")


def is_emoji_noise(x: Column) -> Column:
    """Empty, or only selectors, joiners and skin tones."""
    return x.rlike(rf"\A[{JOINERS}\x{{1F3FB}}-\x{{1F3FF}}]*\z")


def tokenize(x: Column) -> Column:
    """Lower-cased runs of letters and decimal digits."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{Nd}]+"), 0)


def approx_tokens(x: Column, least: int = 0) -> Column:
    return F.greatest((F.length(x) / 4).cast("int"), F.lit(least))


def trigrams(x: Column) -> Column:
    """Distinct trigrams of the words, each padded with two blanks before and one after."""
    padded = F.transform(tokenize(x), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the trigram sets; 0 if both are empty."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def normalize_for_repeat(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{Nd}]+", " "))


def is_repeat(a: Column, b: Column) -> Column:
    """Same text after normalisation, or one contained in the other and at least 60 % of it."""
    x, y = normalize_for_repeat(a), normalize_for_repeat(b)
    strip = lambda t: F.regexp_replace(t, f"^[{WHITE}]+|[{WHITE}]+$", "")
    swap = F.octet_length(x) > F.octet_length(y)
    short, long = F.when(swap, y).otherwise(x), F.when(swap, x).otherwise(y)
    inside = long.contains(short) & (F.length(short) * 10 >= F.length(long) * 6)
    return F.when((x == "") | (y == ""), strip(a) == strip(b)).otherwise((x == y) | inside)


def parse_reply_messages(x: Column, most: int = 6) -> Column:
    """Lines of a JSON {"messages": [...]} reply, or the whole trimmed text as one; blanks dropped."""
    strip = lambda t: F.regexp_replace(t, f"^[{WHITE}]+|[{WHITE}]+$", "")
    parsed = F.from_json(x, "messages array<string>")["messages"]
    lines = F.filter(F.flatten(F.transform(parsed, lambda m: F.transform(F.split(m, "\n"), strip))), lambda t: t != "")
    whole = F.filter(F.array(strip(x)), lambda t: t != "")
    return F.when(F.size(F.coalesce(lines, F.array().cast("array<string>"))) > 0, F.slice(lines, 1, most)).otherwise(whole)


def episode_line(outgoing: Column, media_kind: Column, emoticon: Column, normalized: Column) -> Column:
    """One line of an episode's text; null where there is nothing to say."""
    sticker = F.when(F.coalesce(emoticon, F.lit("")) != "", F.concat(F.lit("["), emoticon, F.lit("]"))).otherwise("[sticker]")
    body = F.when(media_kind == "sticker", sticker).when(media_kind.isin("voice", "round"), F.lit("[voice]")).otherwise(normalized)
    return F.when(~is_blank(body), F.concat(F.when(outgoing, "→ ").otherwise("← "), body))


def sticker_emoticon(meta: Column) -> Column:
    return F.get_json_object(meta, "$.Emoticon")


def length_sigmoid(tokens: Column, k: float = 10, cap: int = 100) -> Column:
    # inside transform the tokens are counted once, not for each time that their number is used
    factor = F.transform(F.array(F.least(tokens.cast("double"), F.lit(float(cap)))), lambda n: F.when(n > 0, n / (n + k)).otherwise(0.0))
    return F.get(factor, F.lit(0))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two arrays; null if one is all zero. The large-data form is operators.vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, 1 - dot(a, b) / norm)


def same_utc_day(a: Column, b: Column) -> Column:
    return F.to_date(a) == F.to_date(b)


def hour_of_day(x: Column) -> Column:
    return F.hour(x)


def is_very_short(x: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(x, F.lit("")), "[ \n\t]", "")) < 5


def preview(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("…"))).otherwise(x)
