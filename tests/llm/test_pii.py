import hashlib
import random
import re

import numpy as np

from sluice.llm import pii
from sluice.llm.boosting import BoostedTrees
from tests.llm.helpers import LONG_TEXT, clashing, docs_of


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def card(rnd):
    head = "".join(rnd.choice("0123456789") for _ in range(15))
    return next(head + c for c in "0123456789" if luhn(head + c))


def test_base_spans_on_random_texts():
    rnd = random.Random(8)
    for _ in range(20_000):
        text = "".join(rnd.choice("a.@-+1209 ()5bé\n%") for _ in range(rnd.randint(0, 30)))
        assert pii.base_spans(text) == brute(text), text


def test_base_spans_of_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "+1" * 50_000, "1." * 50_000, "1 " * 50_000, "@" * 100_000, "A1" * 100_000):
        pii.base_spans(text)
        pii.candidates(text)


def corpus(rnd, n):
    rows = []
    for i in range(n):
        bits = ["some words here", f"call +1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}", f"mail jo{i}.x@mail{i % 5}.example.com now", f"card {card(rnd)} paid",
                f"host {rnd.randint(1, 255)}.{rnd.randint(0, 255)}.{rnd.randint(0, 255)}.{rnd.randint(1, 255)} up", f"order {rnd.randint(1000000, 99999999)} done",
                f"token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\"", f"version {rnd.randint(1, 9)}.{rnd.randint(0, 20)}.{rnd.randint(0, 20)}"]
        rnd.shuffle(bits)
        rows.append((i, " and ".join(bits[:rnd.randint(1, 8)])))
    return rows


def test_detect_keeps_the_base_and_adds_more(spark):
    rows = corpus(random.Random(1), 500) + [(9000, "token = \"" + "ab12" * 10 + "\" end"), (9001, "pay card 4111 1111 1111 1112 now")]
    docs = docs_of(spark, rows)
    got = {r.doc_id: r for r in pii.detect(docs, pii.learn(docs)).collect()}
    for d, text in rows:
        base = brute(text)
        assert got[d].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
        spans = got[d].spans.split(",") if got[d].spans else []
        assert set(f"{k}:{s}:{e}" for s, e, k in base) <= set(spans)
        assert [got[d].n_email, got[d].n_ip, got[d].n_card, got[d].n_phone] == [sum(k == w for _, _, k in base) for w in pii.KINDS[:4]]
        at = [tuple(map(int, s.split(":")[1:])) for s in spans if s not in {f"{k}:{a}:{b}" for a, b, k in base}]
        assert all(not (s < e2 and s2 < e) for s, e in at for s2, e2, _ in base)
        assert got[d].n_added == len(at) == len(spans) - len(base)
    assert "secret:9:49" in got[9000].spans


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, "x@y.zz"), (3, LONG_TEXT), (4, "é x@y.zz"), (4, "é x@y.zz")]
    nothing = pii.learn(docs_of(spark, rows))
    assert nothing.trees is None  # too little to learn from: base spans only
    got = sorted(((str(r.doc_id), r.n_email, r.spans) for r in pii.detect(clashing(docs_of(spark, rows)), nothing).collect()))
    assert got == [("1", 0, ""), ("2", 0, ""), ("3", 0, ""), ("4", 1, "email:2:8"), ("4", 1, "email:2:8"), ("None", 1, "email:0:6")]
    assert [(r.doc_id, r.text) for r in pii.redact(docs_of(spark, rows[-2:-1] + rows[:1]), nothing).collect()] == [(4, "é [email]"), (1, None)]


def test_empty_table(spark):
    docs = docs_of(spark, [])
    assert pii.detect(docs, pii.learn(docs)).count() == 0


def test_trees_learn_a_rule():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5)).astype(float)
    trees = BoostedTrees().fit(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0) == y[2000:]).mean() > 0.97


def test_calibration_is_near_the_rates():
    rnd = np.random.default_rng(0)
    odds = rnd.normal(size=4000) * 3
    y = (rnd.random(4000) < 1 / (1 + np.exp(-(0.5 * odds - 1)))).astype(float)
    a, b = pii.calibrate(odds, y)
    assert abs(a - 0.5) < 0.08 and abs(b + 1) < 0.15


def iban(rnd, country="DE", n=18):
    digits = "".join(rnd.choice("0123456789") for _ in range(n))
    check = 98 - int("".join(str(int(c, 36)) for c in digits + country + "00")) % 97
    plain = f"{country}{check:02d}{digits}"
    return " ".join(plain[i:i + 4] for i in range(0, len(plain), 4))


def test_accounts_and_at_addresses_are_learned_and_selected(spark):
    rnd = random.Random(4)
    rows = [(d, f"{text} and {rnd.choice([f'pay to {iban(rnd)} soon', f'jo{d} (at) mail{d % 5} (dot) example.com wrote', f'part AB12 {rnd.randint(1000, 9999)} {rnd.randint(1000, 9999)} here'])}")
            for d, text in corpus(rnd, 600)]
    one, two = iban(rnd), iban(rnd, "BE", 12)
    odd = [(9000, f"see {one} there"), (9001, f"see {two} PAID there"), (9002, "write ann.lee (at) example (dot) org. Then rest"), (9003, "look (at) this")]
    docs = docs_of(spark, rows + odd)
    detector = pii.learn(docs)
    assert {"account", "email"} <= detector.thresholds.keys()
    assert pii.Detector(None, {}, {}).select([odd[0][1]], [[]]) == [[(4, 4 + len(one), "account")]]
    got = {r.doc_id: r.spans for r in pii.detect(docs, detector).collect()}
    assert got[9000] == f"account:4:{4 + len(one)}" and got[9001] == f"account:4:{4 + len(two)}"
    assert got[9002] == f"email:6:{odd[2][1].index('. Then')}" and got[9003] == ""
    for d, text in rows:
        for kind, pattern in (("account", r"(?<=pay to )DE[0-9 ]+[0-9]"), ("email", r"jo[0-9]+ \(at\) \S+ \(dot\) example\.com")):
            for m in re.finditer(pattern, text):
                assert f"{kind}:{m.start()}:{m.end()}" in got[d].split(",")


def test_unlabelled_proposals_are_no_negatives():
    def label(text, kind):
        return {pii.evidence(text, c, pii.base_spans(text)) for c in pii.candidates(text) if c[2] == kind}
    assert label("ring 555-123-4567 then", "phone") == {0} and label("call 555-123-4567 then", "phone") == {1}
    assert label("the 12345678 things", "phone") == {-1} and label("at 10.20.30.40 now", "phone") == {-1}
    assert label("card 4111 1111 1111 1112 now", "card") == {0} and label("the 4111 1111 1111 1112 now", "card") == {-1}
    assert label("bob (at) example (dot) com", "email") == {1} and label("look (at) this", "email") == {-1}


def test_long_values_are_proposed_whole():
    rnd = random.Random(9)
    blob = "".join(rnd.choice("abcdefXYZ0123456789") for _ in range(3000))
    for value, kind, lead in ((blob, "secret", "token = "), (blob, "secret", "the "), ("q" * 400 + "7" + "q" * 400, "secret", "the "), ("a" * 300 + "(at)example.com", "email", "write "),
                              ("joe (at) " + "b" * 200 + ".com", "email", "write "), ("1.2.3.4567890", "ip", "see ")):
        assert (len(lead), len(lead) + len(value), kind) in pii.candidates(f"{lead}{value} end")
    for text in ("a" * 200_000, "token=" * 30_000, "a1" * 100_000, "a." * 100_000, "1." * 100_000, "a (at) " * 30_000, "a@b." * 50_000):
        pii.candidates(text)  # in linear time
    text = f"token = {blob} end"
    assert pii.Detector(FlatTrees(), {}, {"secret": 0.5}).select([text], [[]]) == [[(8, 3008, "secret")]]


class FlatTrees:
    def score(self, x):
        return np.ones(len(x))


def test_no_proposal_has_more_digits_than_its_kind(spark):
    pair = "4111111111111111 4012888888881881"
    assert not [c for c in pii.candidates(f"numbers {pair} here") if c[2] == "phone"]
    assert pii.kind_of("number", "+" + "1" * 16) is None and pii.kind_of("number", "5" * 15) == "card" and pii.kind_of("number", "555-123-4567") == "phone"


def test_counts_of_added_spans_and_recall_of_secrets(spark):
    """Planted secrets, accounts and (at) addresses: at least nine of ten are found, and the counts show documents without base spans."""
    rnd = random.Random(31)
    secret = lambda: rnd.choice(["sk_live_", "ghp_", "AKIA"]) + "".join(rnd.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(32))
    made = {"secret": lambda d: f"token = {secret()}" if d % 2 else f"password: {secret()}", "account": lambda d: f"pay to {iban(rnd)} soon",
            "email": lambda d: f"mail jo{d} (at) host{d % 7} (dot) example.com today"}
    rows, planted = [], {}
    for d, text in corpus(rnd, 600):
        kind = rnd.choice([None, *made])
        rows.append((d, text if kind is None else f"{text} {made[kind](d)}"))
        planted[d] = kind
    docs = docs_of(spark, rows)
    got = {r.doc_id: r for r in pii.detect(docs, pii.learn(docs)).collect()}
    for kind in made:
        held = [d for d, k in planted.items() if k == kind]
        found = [d for d in held if f"{kind}:" in got[d].spans]
        assert len(found) >= 0.9 * len(held) > 50, kind
    for r in got.values():
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert r.n_spans == len(kinds) and r.n_secret == kinds.count("secret") and r.n_account == kinds.count("account")
        assert r.n_added == r.n_spans - r.n_email - r.n_ip - r.n_card - r.n_phone or r.n_added <= r.n_spans
