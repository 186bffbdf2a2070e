import hashlib
import math
import random
import re
import string

import pytest

from tests.llm.conftest import EDGES, text_of
from tidewheel.llm import queries, secrets

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def random_token(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def corpus(seed=13, n=150):
    rng = random.Random(seed)
    rows = list(EDGES)
    for d in range(n):
        parts = [text_of(rng, rng.randrange(1, 40))]
        for _ in range(rng.randrange(3)):
            hexes = random_token(rng, "0123456789abcdef", rng.choice([8, 31, 32, 40]))
            parts.append(rng.choice(["", "\U0001f600 ", "é"]) + rng.choice(["token = ", "PassWord:'", "api_key=", "API KEY ", 'apikey" : "', "secret=token: ", "token: api_key: ", "passwd=ab\ntoken=", "AKIA", "xAKIA", ""]) + rng.choice([hexes, hexes.upper(), "short", "AKIA" + hexes.upper()]))
            parts.append(text_of(rng, rng.randrange(1, 9)))
        rows.append((1000 + d, " ".join(parts)))
    return rows


def test_op2_base_spans_equal_brute_force(spark, make, table):
    rows = corpus()
    found = queries.op2_secret_scan(spark, table(documents=make(rows))).collect()
    expected = []
    for doc, text in rows:
        spans = brute(text)
        listed = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        expected.append((doc, *(sum(x[1] == k for x in spans) for k in range(3)), hashlib.sha256(listed.encode()).hexdigest()))
    assert sorted((tuple(r[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")) for r in found), key=str) == sorted(expected, key=str)
    for r in found:
        every = [x.split(":") for x in r["spans"].split(",") if x]
        assert [x for x in every if x[0] != "random"] == [x for x in every if x[0] in secrets.KINDS[:3]]
        order = [(int(x[1]), secrets.KINDS.index(x[0])) for x in every]
        assert order == sorted(order)


def test_random_tokens_are_found_and_ordinary_ones_are_not(spark, make):
    rng = random.Random(1)
    secret = [random_token(rng, a, n) for a in (string.digits + "ABCDEF", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/") for n in (40, 48, 64)]
    plain = ["internationalization2024support", "user_name_backup_2023_final_version", "0123456789abcdef0123456789abcdef", "aaaaaaaaaaaaaaaaaaaa1111111111", "https/example/com/Path/To/Some/Page2", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "version1version2version3version4", "deadbeefdeadbeefdeadbeef00000000"]
    rows = [(i, f"see {x} here") for i, x in enumerate([*secret, *plain])]
    found = {r["doc_id"]: [x for x in r["spans"] if x["kind"] == 3] for r in secrets.scan(make(rows)).collect()}
    assert all(found[i] and found[i][0]["s"] == 4 and found[i][0]["e"] == 4 + len(x) for i, x in enumerate(secret)), found
    assert not any(found[len(secret) + i] for i in range(len(plain)))


def test_benjamini_hochberg():
    histogram = [(0, 0, 900), (0, 40, 100), (1, 0, 5), (2, 12, 1), (2, 0, 9)]
    assert secrets.least_bins(histogram, 0.001) == [16, secrets.BINS + 1, secrets.BINS + 1, secrets.BINS + 1]


def test_scan_stays_in_the_jvm(spark, make):
    plan = secrets.scan(make(corpus()[:20]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("n", [0, 3])
def test_without_secrets(spark, make, table, n):
    rows = [(i, "nothing here") for i in range(n)]
    found = queries.op2_secret_scan(spark, table(documents=make(rows))).collect()
    assert [(r["n_assign"], r["spans"], r["base_sha256"]) for r in found] == [(0, "", hashlib.sha256(b"").hexdigest())] * n


def test_long_texts(spark, make):
    text = ("word " * 30000 + "token=" + "a1b2" * 5000 + " ") + "token=abcdefgh " * 3000
    found = secrets.scan(make([(1, text)])).first()["spans"]
    assert [(x["s"], x["kind"], x["e"]) for x in found if x["kind"] < 3] == brute(text)




def plain_bin(token):
    """(stratum, bin) of a candidate by the three tests written out, or None for a token that fits no encoding."""
    fits = [e for e in secrets.ENCODINGS if re.search(e[1], token) and re.search(e[2], token)]
    if not fits:
        return None
    alphabet, n = fits[0][3], len(token)
    a, x = len(alphabet), [alphabet.index(c) for c in token]
    expected = n / a
    chi = sum((x.count(v) - expected) ** 2 / expected for v in range(a))
    cube = 2 / (9 * (a - 1))  # Wilson and Hilferty
    uniform = ((max(0.0, chi) / (a - 1)) ** (1 / 3) - (1 - cube)) / math.sqrt(cube)
    high = [v >= a / 2 for v in x]
    n1 = sum(high)
    n2, turns = n - n1, 1 + sum(p != q for p, q in zip(high, high[1:], strict=False))
    spread = 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1))
    runs = (turns - (2 * n1 * n2 / n + 1)) / math.sqrt(spread) if spread > 0 else 99
    mean = sum(x) / n
    var = sum((v - mean) ** 2 for v in x)
    serial = (sum((p - mean) * (q - mean) for p, q in zip(x, x[1:], strict=False)) / var + 1 / n) * math.sqrt(n) if var > 0 else 99
    kinds = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in token]
    changes = sum(p != q for p, q in zip(kinds, kinds[1:], strict=False))
    extra = n * (a * 0.12 - 1)
    even = (a - 1 + extra - chi) / math.sqrt(2 * (a - 1) + 4 * extra)
    changing = (changes - (n - 1) * 0.15) / math.sqrt((n - 1) * 0.15 * 0.85)
    z = max(1.0, (even + changing) / math.sqrt(2))
    p = math.exp(-z * z / 2) / (z * math.sqrt(2 * math.pi))
    passes = uniform < 3.3 and abs(runs) < 3.3 and abs(serial) < 3.3
    return sum(n >= s for s in (32, 48, 96)), min(400, math.floor(-4 * math.log10(p))) if passes else 0


def plain_random(rows, rate):
    """Random spans of each row: Benjamini-Hochberg step-up on the tokens of a stratum, one by one."""
    tokens = [(i, m.start(), m.end(), plain_bin(m[0])) for i, (_, text) in enumerate(rows) for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text or "")]
    tokens = [t for t in tokens if t[3] is not None]
    found = [[] for _ in rows]
    for stratum in range(4):
        own = sorted((t for t in tokens if t[3][0] == stratum), key=lambda t: -t[3][1])
        last = max((k for k, t in enumerate(own, 1) if t[3][1] > 0 and 10 ** (-t[3][1] / 4) <= rate * k / len(own)), default=0)
        least = own[last - 1][3][1] if last else math.inf  # tokens of one bin go together
        for i, s, e, (_, b) in own:
            if b >= least:
                found[i].append((s, e))
    return [sorted(x) for x in found]


@pytest.mark.parametrize("rate", [0.001, 0.05])
def test_random_spans_equal_an_independent_battery(spark, make, rate):
    rng = random.Random(21)
    alphabets = ["0123456789abcdef", string.ascii_lowercase + string.digits, string.ascii_uppercase + "234567", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_"]
    rows = list(EDGES)
    for d in range(400):
        parts = []
        for _ in range(rng.randrange(4)):
            n = rng.choice([20, 24, 31, 32, 40, 48, 64, 96, 130])
            token = random_token(rng, rng.choice(alphabets), n)
            words = "".join(rng.choice(["user", "Name", "path", "2024", "value", "Get", "7", "data", "x9"]) for _ in range(n // 3))
            parts += [rng.choice([token, words, words + token[:6], token[:10] * (n // 10 + 1)]), text_of(rng, rng.randrange(5))]
        rows.append((5000 + d, " ".join(parts)))
    found = secrets.scan(make(rows), rate).collect()
    got = sorted(((r["doc_id"], [(x["s"], x["e"]) for x in r["spans"] if x["kind"] == 3]) for r in found), key=str)
    expected = sorted(((doc, spans) for (doc, _), spans in zip(rows, plain_random(rows, rate), strict=True)), key=str)
    assert got == expected and sum(len(s) for _, s in expected) > 50
