import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.helpers import frame, noisy
from wardline.llm.secret_scan import ENCODINGS, listed, secret_spans

PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)


def brute(text):
    out = [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for i, (kind, regex, ok) in enumerate(PATTERNS) for m in regex.finditer(text or "") if ok(m)]
    return [x for *_, x in sorted(out)]


def spans(spark, texts):
    rows = secret_spans(frame(spark, texts)).select("doc_id", listed(F.col("spans")).alias("s")).collect()
    return {r.doc_id: [x for x in r.s.split(",") if x] for r in rows}


def test_base_spans(spark):
    r = random.Random(2)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    parts = ["é😀", "token=token: abcdefghij", "password = \"" + hexes(40) + "\"", "SECRET:short", "api_key='" + hexes(31), hexes(32) + hexes(9), "AKIA" + "Q2" * 8, "AKIAAKIA12", "AKIA" * 5, "passwd=a.b-c_d=", "apikey  :  +/+/+/+/", " ", "\n", "ſecret=12345678", "tokens=" + "x" * 9, "https://x.org/a"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", "ü "]) for _ in range(r.randint(0, 30))) for _ in range(150)] + [None, "", *noisy(3)]
    got = spans(spark, texts)
    for i, t in enumerate(texts):
        assert [x for x in got[i] if not x.startswith("random")] == brute(t), t
    assert sum(len(x) for x in got.values()) > 300


CODE = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_"
LOGISTIC = lambda z: 1 / (1 + math.exp(max(-500.0, min(500.0, -1.5976 * z - 0.07056 * z**3))))


def brute_battery(run):
    """(long enough, p, random) of a run, one character at a time."""
    s = run.rstrip("=")
    n = len(s)
    for pattern, a, least, agree, change in ENCODINGS:
        if re.search(pattern, s):
            break
    square = sum(v * v for v in Counter(s).values())
    chi, df = a * square / n - n, a - 1
    z_chi = (max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))
    x = [CODE.index(c) + 1 for c in s]
    mean = sum(x) / n
    high = [v > mean for v in x]
    n1 = sum(high)
    runs = 1 + sum(p != q for p, q in zip(high, high[1:]))
    want = 2 * n1 * (n - n1) / n + 1
    z_runs = abs(runs - want) / math.sqrt(max((want - 1) * (want - 2) / (n - 1), 1e-9))
    var = max(sum((v - mean) ** 2 for v in x), 1e-9)
    z_lag = abs(sum((p - mean) * (q - mean) for p, q in zip(x, x[1:])) / var + 1 / n) * math.sqrt(n)
    expected = n * (n - 1) / 2 * agree
    z = [(expected - (square - n) / 2 - 0.5) / math.sqrt(expected)]
    if change is not None:
        kind = ["d" if c.isdigit() else "m" if c in "+/-_" else "u" if c.isupper() else "l" for c in s]
        z.append((sum(p != q for p, q in zip(kind, kind[1:])) - 0.5 - (n - 1) * change) / math.sqrt((n - 1) * change * (1 - change)))
    pairs = [(p.lower() in "aeiou") != (q.lower() in "aeiou") for p, q in zip(s, s[1:]) if p.isalpha() and q.isalpha()]
    if a > 16 and pairs:
        m = len(pairs)
        z.append((m * 0.66 - sum(pairs) - 0.5) / math.sqrt(m * 0.66 * 0.34))
    return n >= least, LOGISTIC(-sum(z) / math.sqrt(len(z))), z_chi / math.sqrt(2 / (9 * df)) < 3.29 and z_runs < 3.29 and z_lag < 3.29


def brute_random(text):
    """Spans of kind random: unbroken runs that touch no base span, judged under Benjamini-Hochberg."""
    base = [tuple(map(int, x.split(":")[1:])) for x in brute(text)]
    cand = []
    for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", text or ""):
        if not any(a < m.end() and m.start() < b for a, b in base):
            long, p, random_ = brute_battery(m[0])
            if long:
                cand.append((p, random_, m))
    cut = max((p for i, p in enumerate(sorted(p for p, *_ in cand)) if p <= 0.01 * (i + 1) / len(cand)), default=-1)
    return [f"random:{m.start()}:{m.end()}" for p, ok, m in cand if ok and p <= cut]


ALPHABETS = {"hex": (CODE[:16], 20), "letters": (CODE[10:36], 26), "base 32": (CODE[36:62] + "234567", 24), "letters and digits": (CODE[:36], 20), "base 64": (CODE[:64], 20)}


def test_battery_against_brute_force(spark):
    r = random.Random(8)
    draw = lambda: "".join(r.choice(r.choice(list(ALPHABETS.values()))[0]) if i % 3 == 0 else r.choice(a) for a in [r.choice(list(ALPHABETS.values()))[0]] for i in range(r.randint(15, 50)))
    same = lambda: "".join(r.choice(a) for a in [r.choice(list(ALPHABETS.values()))[0]] for _ in range(r.randint(18, 44)))
    parts = [draw, same, same, lambda: "token=" + same(), lambda: r.choice("0123456789abcdef") * 33 + same(), lambda: "AKIA" + "7" * 14, lambda: "ordinary_words-in/a/path_of_text", lambda: same() + "==", lambda: "é"]
    texts = [" ".join(r.choice(parts)() for _ in range(r.randint(0, 12))) for _ in range(250)] + [None, ""]
    got = spans(spark, texts)
    for i, t in enumerate(texts):
        assert [x for x in got[i] if x.startswith("random")] == brute_random(t), t
    assert sum(x.startswith("random") for s in got.values() for x in s) > 200


def test_recall_at_the_least_length_of_each_encoding():
    r = random.Random(3)
    for name, (alphabet, least) in ALPHABETS.items():
        for n in (least, least + 8):
            judged = [brute_battery("".join(r.choice(alphabet) for _ in range(n))) for _ in range(1500)]
            assert sum(long and ok and p <= 0.01 for long, p, ok in judged) >= 0.88 * len(judged), (name, n)


def test_a_text_full_of_base_spans_and_runs(spark):
    r = random.Random(4)
    text = " ".join(("AKIA" + "B" * 12, "".join(r.choice(CODE[:64]) for _ in range(30)))[i % 2] for i in range(6000))
    assert [x for x in spans(spark, [text])[0] if x.startswith("random")] == brute_random(text)


def test_battery_tells_random_from_written(spark):
    r = random.Random(6)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    secret = ["".join(r.choice(alphabet) for _ in range(40)) for _ in range(40)]
    plain = ["erntingingreingertioned", "keitlichenlichkeitbericht", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "abcabcabcabcabcabcabcabcabcabc", "00000000000000000000001", "donaudampfschifffahrtsgesellschaft", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "application/x-www-form-urlencoded", "wp-content/uploads/2019/05/IMG_4821", "getElementsByClassNameAndTagName"]
    got = spans(spark, [f"see {s} there" for s in secret + plain])
    assert sum(got[i] == [f"random:4:{4 + 40}"] for i in range(40)) >= 36
    assert all(got[40 + i] == [] for i in range(len(plain)))


def test_many_matches_and_empty_table(spark):
    text = ("AKIA" + "B" * 12 + " ") * 3000
    assert spans(spark, [text])[0] == brute(text)
    assert spans(spark, []) == {}


def test_a_run_of_a_million_characters(spark):
    """One inline image: its run is judged in steps that follow its length."""
    r = random.Random(8)
    run = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))
    rows = [(1, f"data:image/png;base64, {run} end"), (2, "a" * 1_000_000), (3, None)]
    began = time.time()
    got = {x["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in x["spans"]] for x in secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == [(23, 1_000_023, "random")] and got[3] == [] and time.time() - began < 120
