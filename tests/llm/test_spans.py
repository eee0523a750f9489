import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from scorewell.llm import disclosure, markov_secrets

from .conftest import prose

digits = lambda s: re.sub("[^0-9]", "", s)


def luhn(d):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
]
SECRET = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
]


def brute(text, patterns):
    found = [(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(patterns) for m in re.finditer(p, text or "") if ok(m)]
    return [(k, s, e) for s, _, e, k in sorted(found)]


def noisy(seed):
    rng = random.Random(seed)
    parts = ["a@b.c", "x_y@d-e.f.gh@i.jk", "@", ".", "1.2.3.4", "300.1.2.3.4", "4111 1111-1111 1111", "4111111111111111", "+49 (30) 1234-567", "+1", " ",
             "0", "é", "😀", "-", "token=", 'Api_Key : "', "AKIA", "ABCDEFGHIJ0123456789", "deadbeefdeadbeef00", "PassWord==abcdef12345678", "\n", "word "]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))


def test_base_spans_equal_a_plain_search(spark):
    texts = [noisy(i) for i in range(300)] + [None, "", "1" * 30_000, "a." * 20_000, "a@" + "b." * 8_000, "1 " * 20_000, "\0" * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("secret_spans", F.lit(1))
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in disclosure.personal_data(docs).collect()}
    ratios = [0.0] * (67 * 66)
    hid = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secret_base] for r in markov_secrets.secrets(docs, ratios).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t, PERSONAL), t
        assert hid[i] == brute(t, SECRET), t


def test_revealing_terms(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 60)) for i in range(300)]
    rows += [(1000 + i, f"{prose(rng, 20)} Zaphodius wrote from z@beeble.org {prose(rng, 20)}") for i in range(6)]
    rows += [(2000 + i, rows[-1][1].replace("Zaphodius", "Copyism").replace("z@beeble", "c@copy")) for i in range(9)]
    docs = spark.createDataFrame(rows + [(None, None), (7, rows[7][1])], "doc_id long, text string")
    found = disclosure.personal_data(docs).collect()
    assert len(found) == len(rows) + 2
    texts = dict(rows)
    terms = {(r.doc_id, texts[r.doc_id][s.start : s.end]) for r in found if r.doc_id for s in r.spans if s.kind == "term"}
    assert {(1000 + i, "Zaphodius") for i in range(6)} <= terms
    assert not any(i < 1000 for i, _ in terms) and not any(t == "Copyism" for _, t in terms)
    clean = {r.doc_id: r.text for r in disclosure.sanitise(docs).collect()}
    assert "Zaphodius" not in clean[1000] and "[EMAIL]" in clean[1000] and clean[5] == rows[5][1]


def brute_terms(texts):
    """Term spans by plain counting: leave-one-out chance of an entity given a term, Wilson's lower end, as a share of its information."""
    parts = {}
    for t in set(texts):
        spans, rest = brute(t, PERSONAL), list(t)
        for _, s, e in spans:
            rest[s:e] = " " * (e - s)
        rest = "".join(rest)
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_](?:[^\W_]|['-]){2,}", rest)]
        parts[t] = ({(k, t[s:e].lower()) for k, s, e in spans}, words)
    z, total, n, df, both = disclosure.DOUBT, len(parts), Counter(), Counter(), Counter()
    for found, words in parts.values():
        terms = {w for *_, w in words}
        n.update(found)
        df.update(terms)
        both.update((e, w) for e in found for w in terms)
    risky = set()
    for (e, w), k in both.items():
        k, m = k - 1, df[w] - 1
        if k and n[e] < total:
            low = (k / m + z * z / (2 * m) - z * math.sqrt(k / m * (1 - k / m) / m + z * z / (4 * m * m))) / (1 + z * z / m)
            if 1 + math.log(low) / math.log(total / n[e]) >= disclosure.GENERALISE:
                risky.add(w)
    return {t: [(s, e) for s, e, w in words if w in risky] for t, (_, words) in parts.items()}


def test_revealing_terms_equal_plain_counting(spark):
    """Terms far from a mention, in texts without one, of two texts alone, and of texts that are there many times."""
    rng = random.Random(17)
    texts = [prose(rng, 40) for _ in range(400)]
    texts += [f"mail q@far.org {prose(rng, 60)} Trillian {prose(rng, 20)}" for _ in range(8)] + [f"{prose(rng, 10)} trillian {prose(rng, 10)}"]
    texts += [f"{prose(rng, 30)} call +49 30 123456 or x@two.org {prose(rng, 30)} Onlytwo" for _ in range(2)]
    texts += [f"ip 10.0.0.1 Manycopies {prose(rng, 5)}"] * 30 + ["", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[405])], "doc_id long, text string")
    want = brute_terms([t or "" for t in texts])
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "term"] for r in disclosure.personal_data(docs).collect()}
    assert got[None] == want[texts[405]]
    assert [got[i] for i in range(len(texts))] == [want[t or ""] for t in texts]
    named = {(i, texts[i][s:e].lower()) for i in range(len(texts)) for s, e in got[i]}
    assert {(400 + i, "trillian") for i in range(9)} <= named and not any(w == "manycopies" for _, w in named)


def test_random_strings_are_told_from_words(spark, docs):
    ratios = markov_secrets.fit(docs)
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    secret = ["".join(rng.choices(letters, k=32)) for _ in range(50)]
    plain = ["".join(w for w in prose(rng, 12).rstrip(".").split())[:32] for _ in range(50)]
    rows = [(i, f"see {s} there") for i, s in enumerate(secret + plain)] + [(100, None), (101, "")]
    got = {r.doc_id: r.secret_spans for r in markov_secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string"), ratios).collect()}
    assert sum(any(s.kind == "random" for s in got[i]) for i in range(50)) >= 48
    assert sum(len(got[i]) for i in range(50, 102)) <= 2


def test_empty_tables(empty):
    assert disclosure.personal_data(empty).collect() == []
    assert markov_secrets.secrets(empty, markov_secrets.fit(empty)).collect() == []
