import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import pii, secrets

from .conftest import SF, TRICKY

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRETS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
TEXTS = [
    "a@b.co@c.de x@y @z.com a.b@c-d.e.f. %+-@x.y", "1.2.3.4.5.6.7.8 999.1.1.1 256.1.1.1 0255.1.1.1 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111 1 2 3", "+1 (988) 555-2485 +12345 +1 ((((((( 9 + 4 +33 1 23 45 67 89.",
    "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" PASSWORD:abcdefghijkl Api_Key='x' apikey==aaaaaaaaaaaa secret=a.b",
    "AKIAABCDEFGHIJKLMN AKIAABC deadbeefdeadbeef deadbeefdeadbee paſſword=abcdefghijklmn toKen=abcdefghijklmn", "passwordpassword: = x token:token=abcdefghijklmnop",
]


def brute_pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text):
            s = m[0]
            digits = re.sub("[^0-9]", "", s)
            if kind == "ip" and any(int(p) > 255 for p in s.split(".")):
                continue
            if kind == "card":
                total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) for i, d in enumerate(reversed(digits)))
                if not 16 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def brute_secrets(text):
    out = []
    for rank, (kind, pattern) in enumerate(SECRETS.items()):
        for m in re.finditer(pattern, text, re.A):
            if (kind == "assign" and len(m[2]) >= 12) or (kind == "access" and len(m[0]) >= 18) or (kind == "hex" and len(m[0]) >= 16):
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(out)]


def digest(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def same(rows, texts, brute):
    for r in rows:
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == digest(base), texts[r.doc_id][:200]
        assert set(base) <= set(r.spans.split(",")) | ({""} if not base else set())


def test_patterns_on_hard_texts():
    for text in TEXTS:
        assert [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in pii.base_spans(text)] == brute_pii(text)
        assert [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(secrets.base_spans(text))] == brute_secrets(text)


def test_queries_against_brute_force(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = pii.op3_weak_supervision_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    same(rows, texts, brute_pii)
    for r in rows:
        base = brute_pii(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in base) for k in PII]
    rows = secrets.op6_guess_cost_secrets(spark, SF).collect()
    assert len(rows) == len(texts)
    same(rows, texts, brute_secrets)


def test_tricky_rows(tricky):
    texts = {i: t or "" for i, t in TRICKY}
    for rows, brute in ((pii.detect(tricky).collect(), brute_pii), (secrets.scan(tricky).collect(), brute_secrets)):
        assert len(rows) == len(TRICKY)
        same(rows, texts, brute)
    assert pii.detect(tricky.limit(0)).count() == secrets.scan(tricky.limit(0)).count() == secrets.redact(tricky.limit(0)).count() == 0


def test_hidden_addresses_in_any_case_and_length():
    name, host = "n" * 200, "h" * 100
    for text, want in (
        ("x[AT]y.com", ["x[AT]y.com"]), ("a b (At) c [DOT] d. Next one", ["b (At) c [DOT] d"]), (f"{name} [at] {host}.a.b.c.d.e.f end", [f"{name} [at] {host}.a.b.c.d.e.f"]),
        ("p[at]q.de[at]r.fr", ["p[at]q.de"]), ("look [at] that", []), ("[at] x.com", []),
    ):
        assert [text[s:e] for _, s, e in pii.loose_spans(text, [])] == want, text


def test_many_leading_zeros_are_one_part():
    text = "0" * 5000 + ".1.1.1 and 1.2.3." + "9" * 5000
    assert pii.base_spans(text) == [(1, 0, 5006)]


def test_many_spans_take_linear_time():
    import time

    start = time.perf_counter()
    assert len(pii.loose_spans("020 7946 0958; " * 50_000, [])) == 50_000
    text = "password: x9#Kq!7vZp2 \n" * 20_000
    assert len(secrets.guessed_spans(text, secrets.base_spans(text), {}, 9.0)) == 20_000
    assert time.perf_counter() - start < 30


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "+" * 100_000, "@" * 100_000, "+1" + "(" * 200_000, "a1" * 100_000):
        pii.base_spans(text), pii.loose_spans(text, []), secrets.base_spans(text)


def test_reliabilities_find_the_truth():
    rng = np.random.default_rng(5)
    truth, counts = rng.random(20_000) < 0.4, {}
    for t in truth:
        v = "".join(("+" if t else "-") if rng.random() < p else rng.choice(list("+0-")) for p in (0.9, 0.7, 0.5, 0.0)) + "10000"
        counts[v, bool(t)] = counts.get((v, bool(t)), 0) + 1
    patterns = sorted({(0, v, sum(counts.get((v, t), 0) for t in (True, False))) for v, _ in counts})
    posterior, rates = pii.reliabilities(patterns)
    right = sum(counts.get((v, bool(p > 0.5)), 0) for (_, v, _), p in zip(patterns, posterior, strict=True))
    assert right > 0.95 * len(truth)
    assert rates[1, 0, 2] > rates[1, 1, 2] > rates[1, 2, 2]
    assert ((pii.span_classifier(patterns, posterior) > 0.5) == (posterior > 0.5)).mean() > 0.9


def test_classifier_adds_hidden_addresses(spark):
    rows = [(i, f"please contact ann.lee{i}@mail.example.com or call +1 (988) 555-24{i:02d} today") for i in range(60)]
    rows += [(100, "please mail ann.lee [at] mail.example.com today"), (101, "see version 12.11 and chapter 333-444 at last")]
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans.startswith("email:12:") and got[100].n_email == 0 and got[101].spans == ""


def test_guess_cost():
    ranks = {w: i + 1 for i, w in enumerate(["password", "horse", "correct", "battery"])}
    cost = lambda v: secrets.guess_cost(v, ranks)
    assert cost("password") < 1 and cost("horsebattery") < 3
    assert cost("2024-03-15") < 6 and cost("19991231") < 6
    assert cost("aaaaaaaaaaaaaaaa") < 3 and cost("qwertyuiop") < 5 and cost("abcabcabcabc") < 5
    assert cost("x9#Kq!7vZp2&Lm") >= secrets.LEAST_COST
    for v in ("horsex9#Kq", "zz2024zz"):
        assert cost(v) <= len(v)


def brute_cost(value, ranks):
    """The cheapest of all segmentations, by plain recursion."""
    low = value.lower()

    def costs(i, j):
        part, out = value[i:j], [float(j - i)]
        if low[i:j] in ranks and j - i >= 3:
            out.append(math.log10(ranks[low[i:j]] * (1 if part == low[i:j] else 2) + 1))
        m = secrets._DATE.match(value, i)
        if m and m.end() == j:
            out.append(math.log10(365 * 120 if j - i > 4 else 120))
        for unit in range(1, (j - i) // 2 + 1):  # the shortest unit that repeats here, as often as it does
            m = re.compile(r"(.{%d})\1+" % unit, re.S).match(value, i)
            if m:
                if m.end() == j:
                    out.append(min(unit * 1.0, math.log10(ranks.get(low[i : i + unit], 0) or 10**unit)) + math.log10((j - i) / unit))
                break
        if j - i >= 3 and all(secrets._neighbours(low[k], low[k + 1]) for k in range(i, j - 1)):
            steps = [(secrets._PLACE[low[k + 1]][0] - secrets._PLACE[low[k]][0], secrets._PLACE[low[k + 1]][1] > secrets._PLACE[low[k]][1]) for k in range(i, j - 1)]
            out.append(math.log10(47 * (j - i)) + sum(a != b for a, b in zip([None, *steps], steps)) * math.log10(4))
        return min(out)

    def best(i):
        if i == len(value):
            return -1.0
        return min(costs(i, j) + 1 + best(j) for j in range(i + 1, len(value) + 1))

    return best(0)


def test_guess_cost_against_all_segmentations():
    ranks = {w: i + 1 for i, w in enumerate(["password", "horse", "correct", "pass", "word", "ors"])}
    for value in ("horse", "Password1", "qwe2024", "ababab", "aabbab", "1999-12-3", "x9#Kq!7v", "horseqwer", "asdaaa12", "zzzhorse", "9876543", "passpass"):
        assert secrets.guess_cost(value, ranks) == pytest.approx(brute_cost(value, ranks)), value


def test_short_random_values_are_found(spark):
    ranks = {"horse": 1}
    for value, found in (("xK9$mQ2!vL", 1), ("kT4#pw9Z", 1), ("Zahlung", 0), ("zahlungszie", 0), ("horse123", 0)):
        assert len(secrets.guessed_spans(f"password: {value} end", [], ranks, secrets.LEAST_COST)) == found, value


def test_guess_and_redact(spark):
    rows = [(1, "the passphrase is x9#Kq!7vZp2&Lm. ok", "en", "s", 5), (2, "my password is horse", "en", "s", 5), (3, "token=abcdefabcdefabcdef12", None, None, None), (4, None, "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert got[1].spans == "guess:18:32" and got[2].spans == "" and got[3].n_assign == 1 and got[3].n_hex == 1
    texts = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert texts == {1: "the passphrase is [secret]. ok", 2: "my password is horse", 3: "[secret]", 4: None}


def test_guessed_spans_are_whole(spark):
    rng = np.random.default_rng(8)
    signs = list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789.-_")
    long = "".join(rng.choice(signs, 400)) + "Q"
    values = {1: f"the token is {long} ok", 2: "password: Abcdefgh1234!x9#Kq7$vZp end", 3: "secret -> Zr4#0123456789abcdef end", 4: f"credentials: {'z' * 100_000} ok"}
    df = spark.createDataFrame([(i, t, "en", "s", 5) for i, t in values.items()], "doc_id long, text string, lang string, source string, n_chars long")
    texts = {r.doc_id: r.text for r in secrets.redact(df, {}, least=9.0).collect()}
    assert texts == {1: "the token is [secret] ok", 2: "[secret] end", 3: "secret -> [secret] end", 4: values[4]}


def test_repeats_are_those_of_the_pattern():
    rng = np.random.default_rng(9)
    for n in range(1, 60):
        value = "".join(rng.choice(list("ab"), n))
        want = [re.compile(r"(.{1,16}?)\1+", re.S).match(value, i) for i in range(n)]
        assert secrets._repeats(value) == [m and (len(m[1]), m.end()) for m in want]


def test_rare_words_beyond_the_dictionary_are_no_secrets(spark):
    words = ["straightforwardness", "incomprehensibility", "donaudampfschiffahrtsgesellschaft", "überwältigungsgefühlslage", "сверхчеловеческий"]
    common = " ".join(f"filler{'abcdefghij'[i % 10] * 3} again" for i in range(100))
    rows = [(i, f"{common} the {w} of it, {w}") for i, w in enumerate(words)] + [(10 + i, f"The password is {w} of it") for i, w in enumerate(words)] * 2
    rows += [(20, "password is Xk9#Kq!7vZp2&Lm now"), (21, "the password is qzxkvjwpqyxkzjvw now")] * 3
    df = spark.createDataFrame([(i, t, "en", "s", 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for most in (1, 4, 100):
        got = {r.doc_id: r.spans for r in secrets.scan(df, most=most).collect()}
        assert got[20] == "guess:12:27" and got[21] == "guess:16:32", "a secret of several copies is no word"
        assert all(got[10 + i] == "" for i in range(len(words)))
    texts = {r.doc_id: r.text for r in secrets.redact(df, most=4).collect()}
    assert texts[20] == "password is [secret] now" and texts[12] == rows[7][1]
    cut = {r.doc_id: r.spans for r in secrets.find(df, {}).select("doc_id", secrets.span_text(F.col("found")).alias("spans")).collect()}
    assert all(cut[10 + i] for i in range(len(words))), "without any ranks they all are"
    for text in ("Mein Kennwort ist Xk9#Kq!7vZp2&Lm", "la contraseña es Xk9#Kq!7vZp2&Lm", "mot de passe : Xk9#Kq!7vZp2&Lm", "Passwort: Xk9#Kq!7vZp2&Lm"):
        assert len(secrets.guessed_spans(text, [], {}, secrets.LEAST_COST)) == 1, text
