"""Base spans against the patterns as they are stated, the field against brute force, and held-out rows."""

import hashlib
import re
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from lexweave.llm import pii

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for place, d in enumerate(reversed(digits)):
        d = int(d) * (1 + place % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def plain_field(text):
    """The best labels of all words of a text, one after the other, without any short cut; as spans in code points."""
    field = pii.trained()
    words = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    signs = [None, None, *(pii.signature(w) for _, _, w in words), None]
    parts = [field.of(s) for s in signs]
    best, back = None, []
    for t in range(len(words)):
        u = parts[t + 2][0] + parts[t + 1][1] + parts[t][2] + parts[t + 3][3]
        if signs[t + 2][4] == 0 and words[t][2] in [w for _, _, w in words[max(0, t - 2) : t]]:
            u = u - np.array([0.0] + [pii.REPEATED] * (len(u) - 1))
        if best is None:
            best = u
        else:
            ways = best[:, None] + field.transitions
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + u
    labels = [int(best.argmax())] if words else []
    for b in reversed(back):
        labels.append(int(b[labels[-1]]))
    out, labels = [], labels[::-1]
    for t, label in enumerate(labels):
        if label:
            a, b = pii.core(words[t][2])
            start, end = words[t][0] + a, words[t][0] + b
            if t and labels[t - 1] == label:
                out[-1] = (out[-1][0], end, out[-1][2])
            else:
                out.append((start, end, pii.LABELS[label]))
    return out


def found(*texts):
    return pii.find_spans(pa.array([None if t is None else t.encode() for t in texts], pa.binary()), pii.Labeller(pii.trained()))


@settings(max_examples=400, deadline=None)
@given(st.text("aB9.@-+ ()1250é_%", max_size=60))
def test_base(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", [
    "x@a.b_c@d.e", "a@b@c.d", "@a.b", "a@b", "a@b..c", "mail a.b%c+d-e@x-y.z.co.", "1.2.3.4.5.6.7.8", "256.1.1.1", "0000255.1.1.01 1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111-",
    "4111  1111 1111 1111", "+1 (228) 555-1624", "+1", "+12", "+1 )", "+49 30 123456 7", "++1234567890+1234567890", "1" * 20, "0" * 4000 + ".1.1.1", "9" * 4000, "é٠.1.1.1 a@b.c", "",
])
def test_base_cases(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "+1" + " " * 2_000_000, "@a" * 1_000_000, "1 " * 1_000_000):
        pii.base_spans(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=4), st.integers(0, 10**6))
def test_viterbi_is_the_best_path(lengths, seed):
    rng = np.random.default_rng(seed)
    k = 3
    scores, transitions = rng.normal(size=(sum(lengths), k)), rng.normal(size=(k, k))
    first = np.cumsum(lengths) - lengths
    got = pii.viterbi(scores, first, np.array(lengths), transitions)
    for f, n in zip(first, lengths, strict=True):
        value = lambda path, f=f: sum(scores[f + t, y] for t, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:]))
        assert tuple(got[f : f + n]) == max(product(range(k), repeat=n), key=value)


def test_decoding_runs_alone_loses_nothing(spark):
    """The runs between certain words give the labels of the whole text."""
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    texts += [" ".join(w for w, _ in row) for row in pii.labelled_rows(1, seed=5)]
    texts += ["Contact Anna Berg", "Anna Anna Anna", "555-0142", "", "  ", "é Contact Chloé Núñez, 12 Adler Street.", "x " * 5000 + "Dear Anna Berg, hello"]
    for text, (base, every) in zip(texts, found(*texts), strict=True):
        added = [s for s in plain_field(text or "") if not any(x < s[1] and s[0] < y for x, y, _ in base)]
        assert base == plain(text or "") and every == pii.listed(base + added)


def test_fits_and_keeps_apart():
    """Rows of another seed: nearly every word is right, and ordinary ones stay ordinary."""
    right = missed = wrong = 0
    for row in pii.labelled_rows(4, seed=77):
        text = " ".join(w for w, _ in row)
        spans, at = found(text)[0][1], 0
        for word, label in row:
            got = {k for s, e, k in spans if s < at + len(word) and e > at and k in pii.LABELS}
            want = {pii.LABELS[label]} if label else set()
            right, missed, wrong = right + bool(want & got), missed + bool(want - got), wrong + bool(got - want)
            at += len(word) + 1
    assert right / (right + missed) > 0.95 and right / (right + wrong) > 0.95


@pytest.mark.parametrize(("text", "kind", "part"), [
    ("Please contact Peter Miller for further details.", "name", "Peter Miller"), ("Dear Mrs. Hofmann, thank you.", "name", "Hofmann"), ("Herr Karl Lindner wohnt hier.", "name", "Karl Lindner"),
    ("phone: 415-555-0199 or later", "phone", "415-555-0199"), ("Call (415) 555-0199 now", "phone", "(415) 555-0199"), ("Telefon: 030/4455667", "phone", "030/4455667"),
    ("write to maria (at) weblog (dot) org please", "email", "maria (at) weblog (dot) org"), ("email: tim.moor[at]blog.net", "email", "tim.moor[at]blog.net"),
    ("She lives at 221 Baker Street now.", "address", "221 Baker Street"),
])
def test_unseen_spans(text, kind, part):
    assert (text.index(part), text.index(part) + len(part), kind) in found(text)[0][1]


def test_whole_query(spark, make_docs, odd_texts):
    rows = [*odd_texts, (500, "é Contact Anna Berg, a@b.co or 1.2.3.4; card 4111 1111 1111 1111, +1 (228) 555-1624"), (501, "\U0001f600 a@b.co"), (502, "a@b.co " * 3000)]
    got = pii.personal_data(make_docs(spark, rows))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"]
    want = []
    for doc_id, text, *_ in rows:
        base = plain(text or "")
        every = pii.listed(base + [s for s in plain_field(text or "") if not any(x < s[1] and s[0] < y for x, y, _ in base)])
        want.append((doc_id, *(sum(s[2] == k for s in base) for k in PATTERNS), pii.written(base), pii.written(every)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert pii.personal_data(make_docs(spark, [])).count() == 0


def test_registered_query(spark):
    got = {r["doc_id"]: r for r in pii.op11_pii(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        base = plain(r["text"] or "")
        mine = got[r["doc_id"]]
        assert mine["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert [mine[f"n_{k}"] for k in PATTERNS] == [sum(s[2] == k for s in base) for k in PATTERNS]
        assert set(pii.written(base).split(",")) - {""} <= set(mine["spans"].split(","))


def test_slices_do_not_change_results(monkeypatch):
    texts = [" ".join(w for w, _ in row) for row in pii.labelled_rows(1, seed=9)] * 3
    want = found(*texts)
    monkeypatch.setattr(pii, "PIECE", 200)
    monkeypatch.setattr(pii, "WORDS", 7)
    monkeypatch.setattr(pii, "REMEMBERED", 5)
    assert found(*texts) == want
