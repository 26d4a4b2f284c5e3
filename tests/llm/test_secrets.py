"""Random tokens planted among ordinary ones."""

import random
import string

import pytest

from chatloom.llm import secret_scan

ALPHABETS = {
    "base64": string.ascii_letters + string.digits + "+/",
    "base32": string.ascii_uppercase + "234567",
    "upper hex": string.digits + "ABCDEF",
    "lower hex": string.digits + "abcdef",
}
LETTERS = {"letters": string.ascii_letters, "upper": string.ascii_uppercase}


def random_token(rng, alphabet, n):
    while True:
        t = "".join(rng.choice(alphabet) for _ in range(n))
        if any(map(str.isdigit, t)) and any(map(str.isalpha, t)) and not secret_scan.HEX.fullmatch(t[:24].ljust(24, "x")):
            return t


def ordinary_token(rng):
    words = rng.choices("the of window river and paper garden letter house winter der und fenster casa jardin papier maison".split(), k=rng.randint(3, 6))
    words.insert(rng.randint(0, len(words)), str(rng.choice([rng.randint(0, 9), rng.randint(1900, 2030), rng.randint(0, 10**6)])))
    joint = rng.choice(["-", "_", "/", ""])
    t = joint.join(words)
    return rng.choice([t, t.upper(), joint.join(map(str.capitalize, words)), f"20{rng.randint(10, 29)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-00"])


def random_spans(spans):
    return {tuple(map(int, x.split(":")[1:])) for x in spans.split(",") if x.startswith("random:")}


@pytest.mark.parametrize("length, least", [(16, 0.6), (20, 0.75), (24, 0.9), (32, 0.95)])
def test_short_random_tokens(spark, length, least):
    rng = random.Random(length)
    rows, planted = [], {}
    for i in range(4000):
        t = ordinary_token(rng)
        if i % 50 == 0:  # a fiftieth of the tests
            name = list(ALPHABETS)[i // 50 % (3 if length >= secret_scan.MIN_HEX else 4)]
            t = random_token(rng, ALPHABETS[name], length)
            planted[i] = name
        rows.append((i, f"see {t} there"))
    found = secret_scan.span_digest(secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    hit = {r.doc_id for r in found.collect() if random_spans(r.spans)}
    for name in set(planted.values()):
        mine = {i for i, n in planted.items() if n == name}
        assert len(hit & mine) >= least * len(mine), name
    assert len(hit - set(planted)) <= 1


@pytest.mark.parametrize("plain", ["abcdefghijklm0123456789nopq", "a1b2c3d4e5f6g7h8i9", "Zq8Xv2Lm" * 3, "aaaa1111" * 2, "a1" * 20, "A" * 60 + "1", string.ascii_letters + string.digits, "2024-01-15T12-30-55Z", "the-old-man-and-the-sea-2"])
def test_plain_tokens(plain):
    assert secret_scan.writing_p(plain) > 0.1


def test_runs_beyond_a_block(spark):
    """Plain and random parts of a long run have verdicts of their own, to its end."""
    rng = random.Random(1)
    blob = "".join(rng.choice(ALPHABETS["base64"]) for _ in range(6000))
    plain = "the-old-man-and-the-sea-2/" * 240
    texts = [f"x {plain}{blob} y", f"x {blob}{plain} y", f"x {plain} y", f"x {blob} y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    secret = [(2 + len(plain), 2 + len(plain) + len(blob)), (2, 2 + len(blob)), (0, 0), (2, 2 + len(blob))]
    for r in secret_scan.span_digest(secret_scan.scan(docs)).collect():
        start, end = secret[r.doc_id]
        found = {i for s, e in random_spans(r.spans) for i in range(s, e)}
        # the parts meet within one block
        assert len(found ^ set(range(start, end))) < 256
    masked = [r.text for r in secret_scan.redact(docs).orderBy("doc_id").collect()]
    assert [t.count("[SECRET]") for t in masked] == [1, 1, 0, 1]
    assert masked[2] == texts[2] and masked[3] == "x [SECRET] y"
    assert all(plain[:5900] in t for t in (masked[0], masked[2])) and plain[-5900:] in masked[1]


@pytest.mark.parametrize("name", [*ALPHABETS, *LETTERS])
@pytest.mark.parametrize("length", [16, 24, 40, 120])
def test_battery_of_random_tokens(name, length):
    """Each test's p-value is low as often as it says, also all three together."""
    rng = random.Random(name + str(length))
    alphabet = (ALPHABETS | LETTERS)[name]
    tokens = ["".join(rng.choices(alphabet, k=length)) for _ in range(1500)]
    tests = [secret_scan.chi_squared_p, secret_scan.runs_p, secret_scan.serial_p]
    for test in tests:
        p = [test(t, alphabet) for t in tokens]
        assert all(0 <= x <= 1 for x in p)
        for level in (0.2, 0.05, 0.01):
            assert sum(x <= level for x in p) <= (1.6 * level + 0.012) * len(p), (test.__name__, level)
    p = [secret_scan.battery(t) for t in tokens]
    for level in (0.2, 0.05, 0.01):
        assert sum(x <= level for x in p) <= (1.6 * level + 0.012) * len(p), level


def test_battery_refutes_patterns():
    base64 = ALPHABETS["base64"]
    assert secret_scan.chi_squared_p("aB3" * 10, base64) < 1e-9
    assert secret_scan.chi_squared_p("thesearetheordinarywordsofthetextandthese", base64) < 1e-4
    assert secret_scan.runs_p("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789", base64) < 1e-6
    assert secret_scan.runs_p("aB1cD2eF3gH4jK5mN6pQ7rS8tU9", base64) < 1e-3
    assert secret_scan.serial_p("".join(sorted(base64)), "".join(sorted(base64))) < 1e-6
    for plain in ("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789", "aaaa1111bbbb2222cccc3333dddd", "internationalisation-of-the-organisations"):
        assert secret_scan.battery(plain) < 1e-3


def plain_spans(texts):
    """Random spans by sorted p-values, one after the other."""
    tests = {}
    for d, text in enumerate(texts):
        base = secret_scan.base_spans(text)
        for m in secret_scan._TOKEN.finditer(text):
            if any(map(str.isalpha, m[0])):
                for s, e in secret_scan.blocks(m.start(), m.end()):
                    if not any(b < e and s < f for b, _, f in base):
                        size = next(i for i, most in enumerate(secret_scan.LENGTH_CLASSES) if e - s <= most)
                        tests.setdefault((size, m[0].isalpha()), []).append((d, s, e))
    out = set()
    for own in tests.values():
        # a p-value counts as its bin's upper edge
        binned = lambda p: 10 ** (-min(secret_scan.BINS, int(-secret_scan.log10(max(p, 1e-300)) * secret_scan.BIN)) / secret_scan.BIN)
        refuted = []
        for test, rate in ((secret_scan.writing_p, secret_scan.FDR), (secret_scan.battery, secret_scan.BATTERY_FDR)):
            p = [binned(test(texts[d][s:e])) for d, s, e in own]
            ok = [x for x in p if x <= rate * sum(y <= x for y in p) / len(p)]
            refuted.append([bool(ok) and x <= max(ok) for x in p])
        out |= {t for t, written, odd in zip(own, *refuted, strict=True) if written and not odd}
    return out


def test_random_spans_by_sorting(spark):
    rng = random.Random(4)
    texts = []
    for i in range(1500):
        t = [ordinary_token(rng), rng.choice(["internationalisation", "Donaudampfschifffahrt", "ABCDEFGHIJKLMNOPQRST"])]
        if i % 20 == 0:
            t.append("".join(rng.choices((ALPHABETS | LETTERS)[rng.choice([*ALPHABETS, *LETTERS])], k=rng.choice([16, 20, 24, 32, 64, 700]))))
        texts.append(f"see {' and '.join(t)} there")
    expected = plain_spans(texts)
    found = secret_scan.span_digest(secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)))
    got = {(r.doc_id, s, e) for r in found.collect() for s, e in random_spans(r.spans)}
    assert got == expected and len({d for d, _, _ in got}) > 40
    letters = [x for x in got if texts[x[0]][x[1] : x[2]].isalpha()]
    assert len(letters) > 5
