"""Personal data: fixed patterns for what has a fixed form, and a linear-chain conditional random field for what hasn't.

The field labels the words of a text by their shapes and those of their neighbours. It is trained on the labelled table below,
by the exact gradient of the conditional likelihood, and decoded by Viterbi over numpy batches. Most words can't be anything
but ordinary: where that label leads by more than all transitions together can win back, it is part of every best path, and
only the runs of words in between are decoded. That changes no result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.llm._common import read, release
from lexweave.llm._words import words_in

#: Kinds of spans, in the order in which spans of one start are listed; the last two come from the field alone.
KINDS = ("email", "ip", "card", "phone", "name", "address")
LABELS = ("-", "email", "phone", "name", "address")
#: Bytes of text, and words, that are worked on at a time; distinct words whose scores are remembered.
PIECE, WORDS, REMEMBERED = 6 << 20, 1 << 17, 400_000
#: Strength of the prior and number of steps when the field is trained; rows that each line of the table is made into.
PRIOR, STEPS, COPIES = 0.02, 160, 8

LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMBER = re.compile(r"[0-9]")

# The labelled table: {kind ...} is what the kind covers, <...> a slot that is filled from SLOTS. Lines without a kind are ordinary.
TABLE = """
Contact {name <first> <last>} for further details.
Please contact {name <first> <last>}, who will help you.
My name is {name <first> <last>} and I live here.
Name: {name <first> <last>}
name: {name <first> <last>}, {address <number> <last> Street}
Dear {name <first> <last>},
Dear Mr. {name <last>}, thank you for the letter.
Kind regards, {name <first> <last>}
Yours sincerely, {name <first> <last>}
Signed by {name <first> <last>} on the first day.
Mr. {name <first> <last>} has said so.
He met Mrs. {name <last>} in the town.
The report of Dr. {name <first> <last>} is here.
Ask for Ms. {name <last>} at the desk.
Prof. {name <last>} gave a talk.
Dear <title> {name <last>}, <word> <word>
<word> <word> <title> {name <first> <last>} <word> <word>.
<word>. <title> {name <last>} <word> <func> <word>
<word> <title> {name <last>}, <word> <func>
Herr {name <first> <last>} wohnt in der Stadt.
Frau {name <last>} hat angerufen.
Ansprechpartner: {name <first> <last>}
Ich heiße {name <first> <last>} und wohne hier.
Monsieur {name <first> <last>} est parti.
Mme {name <last>} a dit oui.
Je m'appelle {name <first> <last>} et je suis ici.
Señor {name <last>} vive en la casa.
Sra. {name <first> <last>} lo ha dicho.
Me llamo {name <first> <last>} y soy de aquí.
Employee: {name <first> <last>}, phone: {phone <local>}
patient {name <first> <last>} was seen today
Call me at {phone <local>} tonight.
call {phone <area> <local>} for help
Phone: {phone <area> <local>}
phone: {phone <local>}
Tel. {phone <trunk>}
Tel: {phone <trunk>} or write
tel {phone <trunk>}
Telefon: {phone <trunk>}
Telefon {phone <trunk>} am Abend
Téléphone : {phone <trunk>}
Teléfono: {phone <trunk>}
Fax: {phone <area> <local>}
mobile {phone <area> <local>}, please
You can reach us at {phone <area> <local>}.
my number is {phone <local>}
Rufen Sie {phone <trunk>} an.
Write to {email <user> at <host> dot <zone>} for more.
write to {email <user> (at) <host> (dot) <zone>} please
Mail: {email <user> [at] <host> [dot] <zone>}
mail {email <user> (at) <host>.<zone>} today
email: {email <user> [at] <host>.<zone>}
E-Mail: {email <user>(at)<host>.<zone>}
email {email <user>[at]<host>.<zone>}
Email me: {email <user> at <host> dot <zone>}
She lives at {address <number> <last> Street} now.
He moved to {address <number> <last> Road}, near the river.
Our address is {address <number> <last> Avenue}.
Address: {address <number> <last> Lane}
address: {address <number> <last> Drive}
Er wohnt in der {address <last>straße <number>} im Ort.
Adresse: {address <last>weg <number>}
Adresse : {address <number> rue <last>}
Elle habite {address <number> rue <last>} ici.
Vive en la {address calle <last> <number>} de aquí.
Dirección: {address Calle <last> <number>}
The house of the old man is on the hill.
It was a good day. The sun was out and <Word> <word> came along.
<Word> <word> <word>, the <word> of <word> and <word>. <Word> <word>.
<Word>. <Word>, <word> the <Word> <word>. <Word> <Word>.
<word> <word> <Word>. <Word> <Word> <word>, <word>.
<Word> <Word> <word> die <Word> und der <Word>. <Word>.
der <Word> hat die <Word> im <Word> <word>. <Word> <word> das <Word>, <Word>.
<Word>, <word> le <word>. <Word> et <word> de la <word>.
<Word> <word> el <word>. <Word> y <word> de <word>.
<word> <word> at the <word> of <word>
<word> is at <word> <word> and dot <word> the <word>
Write to the <word> at <word> for the <word>.
Call the <word> at <word> <word>.
Contact the <word> for <word>.
The address of the <word> is <word>.
The name of the <word> was <word> and <word>.
In <year> the <word> had <count> <word> and <number> <word>.
<year> was a good year, <number> of <number> <word>.
On <date> they paid <price> for <count> <word>.
Version <version> of the <word> was out on <date>.
Order <count> has <number> pages; see page <number>.
<count> <word>, <count> <word>, <number> <Word>.
The <word> costs <price> or <price> in <year>.
<word> token = "<hex>" <word>
<word> key=<hex> <word> <word>
<word> password: <hex> the <word>
<word> <long> <word> the <word>
<word> <hex> <word>
<word> +<number> (<area3>) 555-<year> <word> <word>
<word> <version>.<number> <word>
Copyright (c) <year> the authors. All rights reserved.
Permission is hereby granted, free of charge, to any person obtaining a copy
Licensed under the Apache License, Version <version>; you may not use this file
THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND
SPDX-License-Identifier: MIT <word>
GNU General Public License version <number> or later
Question: what is the <word> of <Word>? Answer: <word>.
A) <Word> B) <word> C) <Word> D) <word>
<func> <func>. <Word> <func> <word> <func>.
<word> <func> this. <Word> a <word> <func>
<word> was. It. <Word> <func> <func>
<func> <word>. <Func> <func>. <Word> <word> <func>
<word> <func> <func>. <Word> <func> <word> <func> <Word>
<word> <func> <func>. <Word> <func> <func> <word>
<func> <func> <func>. <Func>. <Word> <func> <func>
<Func> <func>. <Func>. <Word> <word>, <func> <Word> <word>
<func> <Func>. <Func>. <Func>. <Word> <func> <Func> <Func>. <Word> <Word>.
<Func>. <Func>. <Word> <func> <Word>. <Func> <func>
<func> <func> <Word> <func>. <Word> <Word> <func> <word>.
<same> <same> <word> <word>
<word>. <Same>
<Same> <word>. <word>.
<Same> <func> <func>
Click here to <word>. Cookie policy. Terms of use.
def <word>(<word>): return <word> + <number>
"""
_FUNCTION = "a an the of to it in on is at that and for with was he she by from or as this are be der die das und ein zu mit von im le la les de et un une est dans que y el los en por con es su".split()
_FIRST = "Anna Ben Clara David Elena Frank Grace Hugo Inés Jan Karla Leo María Niklas Olivia Paul Renée Sofia Tom Ute Victor Wanda Émile José Jürgen Chloé".split()
_LAST = "Adler Berg Castro Dubois Evans Fischer García Huber Ivanov Jensen Keller Lopez Müller Novak Olsen Perez Quinn Rossi Schmidt Turner Weber Young Zimmer Lefèvre Núñez".split()


def _fill(slot: str, rng: np.random.Generator) -> str:
    """What stands in a slot of the table."""
    digits = lambda n: "".join(str(d) for d in rng.integers(0, 10, size=n))
    pick = lambda *choices: str(choices[rng.integers(len(choices))])

    def word() -> str:
        return "".join(pick("b", "d", "l", "n", "r", "s", "t", "th", "sch", "qu", "ñ", "") + pick("a", "e", "i", "o", "ou", "é", "ä", "ion", "er", "en") for _ in range(rng.integers(1, 5)))

    made = {
        "first": lambda: pick(*_FIRST), "last": lambda: pick(*_LAST), "number": lambda: digits(rng.integers(1, 4)), "year": lambda: pick("19", "20") + digits(2),
        "local": lambda: digits(3) + pick("-", " ", ".") + digits(4), "area": lambda: pick("({})", "{}", "{}-").format(digits(3)), "area3": lambda: digits(3),
        "trunk": lambda: "0" + digits(pick(2, 3) == "2" and 2 or 3) + pick(" ", "/", "-") + pick(digits(6), digits(3) + " " + digits(4), digits(2) + " " + digits(2) + " " + digits(2)),
        "user": lambda: pick(*_FIRST).lower() + pick("", ".", "_", digits(2)) + pick("", pick(*_LAST).lower()), "host": word, "zone": lambda: pick("com", "org", "net", "de", "fr"),
        "word": word, "Word": lambda: word().capitalize(), "count": lambda: pick(digits(5), digits(2) + "," + digits(3), digits(4)), "price": lambda: pick("$", "€", "") + digits(2) + pick(".99", "", ",50"),
        "date": lambda: pick(f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"1{digits(1)}/0{digits(1)}/20{digits(2)}", f"{digits(1)}. May {digits(4)}"), "version": lambda: pick(digits(1) + "." + digits(1), digits(1) + "." + digits(1) + "." + digits(2)),
        "title": lambda: pick("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Herr", "Frau", "Monsieur", "Mme", "Señor", "Sra."), "func": lambda: pick(*_FUNCTION), "Func": lambda: pick(*_FUNCTION).capitalize(), "same": lambda: " ".join([pick(word(), pick(*_FUNCTION))] * 4),
        "Same": lambda: " ".join([pick(word(), pick(*_FUNCTION)).capitalize() + pick("", "", ".")] * 4), "hex": lambda: "".join(pick(*"0123456789abcdef") for _ in range(pick(16, 24, 40) and rng.integers(12, 41))), "long": lambda: digits(16),
    }
    return made[slot]()


def labelled_rows(copies: int = COPIES, seed: int = 11) -> list[list[tuple[str, int]]]:
    """The table as rows of (word, label), each line ``copies`` times with its slots filled anew."""
    rng, out = np.random.default_rng(seed), []
    for line in TABLE.strip().split("\n"):
        for _ in range(copies):
            row = []
            for kind, marked, plain in re.findall(r"\{(\w+) ([^}]*)\}(?:[.,;:?!]*)|([^{]+)", line):
                text = re.sub(r"<(\w+)>", lambda m: _fill(m.group(1), rng), marked or plain)
                row += [(w, LABELS.index(kind) if kind else 0) for w in text.split()]
            out.append(row)
    return out


_OUTER = re.compile(r"""^[("'\[{<«„“]*(.*?)[)"'\]}>»“”.,;:!?]*$""", re.S)
_TRAIL = ".,;:!?"


def core(word: str) -> tuple[int, int]:
    """Where the word begins and ends without quotes, brackets and closing signs; all of it if nothing else is left. Brackets
    around digits stay."""
    if word[:1] == "(" and word[1:2].isdigit():
        return 0, len(word.rstrip(_TRAIL))
    start, end = _OUTER.match(word).span(1)
    return (start, end) if end > start else (0, len(word))


def shape(word: str) -> str:
    """Letters as X and x, digits as d; runs of letters shortened to one, of digits to five."""
    s = "".join("d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word[:40])
    return re.sub(r"d{6,}", "dddddd", re.sub(r"([Xx])\1+", r"\1", s))


_CUES = frozenset(w.lower() for line in TABLE.split("\n") for w in re.findall(r"[^\W\d_]+", re.sub(r"<\w+>|\{\w+", " ", line)))
#: What a word without digits loses for every other label than the ordinary one if it repeats the word before or the one before that.
REPEATED = 30.0
#: The part of a word for its neighbours to its right (one and two places) and to its left.
ROLES = ("own", "prev", "prev2", "next")
_STREETS = ("straße", "weg")


def signature(word: str) -> tuple:
    """All that features are made from; the words of a language share few of them."""
    word = word[:64]
    stem = word.rstrip(_TRAIL)
    if stem.isalpha() and (stem.islower() or stem[1:].islower()):  # most words
        low = stem.lower()
        kind = "x" if stem[0].islower() else "Xx" if stem[0].isupper() else shape(stem)
        return kind, low if low in _CUES else "?", word[len(stem) : len(stem) + 1], "", 0, False, low[-6:] if low.endswith(_STREETS) else "", False
    a, b = core(word)
    low, digits = word[a:b].lower(), sum(c.isdigit() for c in word)
    street = low[-6:] if digits == 0 and low.endswith(_STREETS) else ""
    return shape(word[a:b]), low if low in _CUES else "?", word[b:][:1], word[:a][:4], min(digits, 12), digits == b - a, street, "(at)" in low or "[at]" in low


def features(word: tuple | None, role: str) -> list[str]:
    """What a word's signature tells about itself, or about the word that has it as a neighbour; None beyond the ends."""
    if word is None:
        return [f"{role}=none"]
    kind, cue, trail, lead, digits, only, street, at = word
    if role == "prev2":
        return [f"prev2 cue={cue}"]
    out = [f"{role} shape={kind}", f"{role} cue={cue}", f"{role} trail={trail}", f"{role} cue+trail={cue}{trail}"]
    if role == "own":
        out += [f"own lead={lead}", f"own digits={digits}", f"own all={only}", f"own street={street}", f"own at={at}", f"own shape+trail={kind}{trail}"]
    return out


class Field:
    """Weights of features by label for each role, and of transitions. ``forced``: the lead by which the ordinary label is
    certain, for each other label."""

    def __init__(self, number: dict[str, int], weights: np.ndarray, transitions: np.ndarray):
        self.number, self.weights, self.transitions = number, weights, transitions
        gain = lambda x: np.maximum(0.0, x.max(axis=0))
        self.forced = gain(transitions - transitions[:, :1]) + gain((transitions - transitions[:1]).T)

    def of(self, word: tuple | None) -> np.ndarray:
        """A signature's part of the scores, by role and label."""
        out = np.zeros((len(ROLES), len(LABELS)))
        for k, role in enumerate(ROLES):
            known = [i for f in features(word, role) if (i := self.number.get(f)) is not None]
            if known:
                out[k] = self.weights[known].sum(axis=0)
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, length: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The best labels of many sequences at once; a sequence is ``length`` rows of ``scores`` from ``first`` on. Of equal paths
    the one with the smaller labels from the end on."""
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    back = np.zeros(scores.shape, dtype=np.int8)
    best = scores[first].copy()
    alive = len(first) - np.searchsorted(length[::-1], np.arange(int(length.max(initial=0)) + 1), "right")  # sequences longer than t
    for t in range(1, int(length.max(initial=0))):
        n = alive[t]
        ways = best[:n, :, None] + transitions
        at = first[:n] + t
        back[at] = ways.argmax(axis=1)
        best[:n] = ways.max(axis=1) + scores[at]
    out = np.zeros(len(scores), dtype=np.int8)
    label = best.argmax(axis=1)
    for t in range(int(length.max(initial=0)) - 1, -1, -1):
        n = alive[t]
        at = first[:n] + t
        out[at] = label[:n]
        label[:n] = back[at, label[:n]]
    return out


@lru_cache(maxsize=1)
def trained(copies: int = COPIES, steps: int = STEPS) -> Field:
    """The field that fits the labelled table: the likelihood's gradient from forward and backward sums over all rows at
    once, with a Gaussian prior, in steps of fixed number (resilient propagation)."""
    rows = labelled_rows(copies)
    number: dict[str, int] = {}
    cache: dict[tuple, list[int]] = {}

    def ids(word: tuple | None, role: str) -> list[int]:
        if (word, role) not in cache:
            cache[word, role] = [number.setdefault(f, len(number)) for f in features(word, role)]
        return cache[word, role]

    n, longest, k = len(rows), max(map(len, rows)), len(LABELS)
    where, which, gold, mask = [], [], np.zeros((n, longest), dtype=np.int64), np.zeros((n, longest))
    for r, row in enumerate(rows):
        words = [None, None, *(signature(w) for w, _ in row), None]
        for t, (_, label) in enumerate(row):
            gold[r, t], mask[r, t] = label, 1.0
            found = ids(words[t + 2], "own") + ids(words[t + 1], "prev") + ids(words[t], "prev2") + ids(words[t + 3], "next")
            where += [r * longest + t] * len(found)
            which += found
    where, which = np.array(where), np.array(which)
    order = np.argsort(where, kind="stable")
    where, which = where[order], which[order]
    places, begin = np.unique(where, return_index=True)
    by_feature = np.argsort(which, kind="stable")
    feature_begin = np.searchsorted(which[by_feature], np.arange(len(number)))
    hot = np.eye(k)[gold] * mask[..., None]
    pairs = np.einsum("rti,rtj->ij", hot[:, :-1], hot[:, 1:])
    w, tr = np.zeros((len(number), k)), np.zeros((k, k))
    size = [np.full(w.shape, 0.05), np.full(tr.shape, 0.05)]
    old = [np.zeros(w.shape), np.zeros(tr.shape)]
    lse = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
    for _ in range(steps):
        u = np.zeros((n * longest, k))
        u[places] = np.add.reduceat(w[which], begin)
        u = u.reshape(n, longest, k)
        forward, backward = np.zeros(u.shape), np.zeros(u.shape)
        forward[:, 0] = u[:, 0]
        for t in range(1, longest):
            new = lse(forward[:, t - 1, :, None] + tr, 1) + u[:, t]
            forward[:, t] = np.where(mask[:, t, None] > 0, new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = lse(tr + (u[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0.0)
        z = lse(forward[:, -1], 1)
        share = np.exp(forward + backward - z[:, None, None]) * mask[..., None]
        both = np.exp(forward[:, :-1, :, None] + tr + (u + backward)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        error = (share - hot).reshape(n * longest, k)
        slopes = np.add.reduceat(error[where[by_feature]], feature_begin) + PRIOR * w, both.sum(axis=(0, 1)) - pairs + PRIOR * tr
        for x, slope, step, before in zip((w, tr), slopes, size, old, strict=True):
            agree = slope * before
            np.clip(step * np.where(agree > 0, 1.2, np.where(agree < 0, 0.5, 1.0)), 1e-6, 0.5, out=step)
            before[:] = np.where(agree < 0, 0.0, slope)
            x -= np.sign(before) * step
    return Field(number, w, tr)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the fixed patterns find, in code points; a time that is linear in the text."""
    out = []
    end, before = 0, 0
    p = text.find("@")
    while p >= 0:
        low = max(end, before)
        start = p - len(LOCAL.match(text[low:p][::-1]).group())
        if start < p and (m := DOMAIN.match(text, p + 1)):
            out.append((start, m.end(), "email"))
            end = m.end()
        before = p + 1
        p = text.find("@", max(before, end))
    if NUMBER.search(text):
        for m in IP.finditer(text):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (g.lstrip("0") for g in m.groups())):
                out.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37:
                digits = [int(c) for c in m.group() if c not in " -"]
                if 12 <= len(digits) <= 19 and sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10 == 0:
                    out.append((*m.span(), "card"))
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((*m.span(), "phone"))
    return listed(out)


def listed(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


class Labeller:
    """Labels the words of Arrow columns of texts. Words' signatures are remembered from batch to batch, and their scores."""

    def __init__(self, field: Field):
        self.field, self.seen = field, {}
        self.rows: dict[tuple | None, int] = {None: 0}
        self.table, self.wordy = field.of(None)[None], np.zeros(1, dtype=bool)

    def scores(self, words) -> np.ndarray:
        """The row in ``table`` of each word."""
        distinct, at, number = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        if len(self.rows) > REMEMBERED:
            self.seen, self.rows, self.table, self.wordy = {}, {None: 0}, self.table[:1], self.wordy[:1]
        seen, rows, made = self.seen, self.rows, []
        out = np.empty(len(distinct), dtype=np.int64)
        for k, (h, s, e) in enumerate(zip(distinct.tolist(), words.start[at].tolist(), words.end[at].tolist(), strict=True)):
            row = seen.get(h)
            if row is None:
                word = signature(words.data[s : min(e, s + 256)].tobytes().decode("utf-8", "ignore"))
                row = rows.get(word)
                if row is None:
                    row = rows[word] = len(rows)
                    made.append((self.field.of(word), word[4] == 0))
                seen[h] = row
            out[k] = row
        if made:
            self.table = np.concatenate([self.table, np.array([x for x, _ in made])])
            self.wordy = np.concatenate([self.wordy, np.array([x for _, x in made])])
        return out[number]

    def spans(self, column: pa.Array) -> dict[int, list[tuple[int, int, str]]]:
        """Row -> (start, end, kind) in bytes of its text."""
        words = words_in(column)
        n = len(words.hash)
        if not n:
            return {}
        number, owner, field = self.scores(words), words.owner(), self.field
        table = self.table
        open_, scores = [], []
        for low in range(0, n, WORDS):
            at = np.arange(low, min(n, low + WORDS))

            def neighbour(step, at=at):
                other = np.clip(at + step, 0, n - 1)
                inside = (at + step >= 0) & (at + step < n)
                inside &= owner[other] == owner[at]
                return np.where(inside, number[other], 0)

            again = np.zeros(len(at), dtype=bool)
            for step in (1, 2):
                again |= (at >= step) & (words.hash[at] == words.hash[at - step]) & (owner[at] == owner[at - step])
            u = table[number[at], 0] + table[neighbour(-1), 1] + table[neighbour(-2), 2] + table[neighbour(1), 3]
            u[again & self.wordy[number[at]], 1:] -= REPEATED
            free = (u[:, :1] - u[:, 1:] <= field.forced[1:]).any(axis=1)
            open_.append(at[free])
            scores.append(u[free])
        open_, scores = np.concatenate(open_), np.concatenate(scores)
        if not len(open_):
            return {}
        starts = np.concatenate([[True], (np.diff(open_) > 1) | (np.diff(owner[open_]) > 0)])
        first = np.flatnonzero(starts)
        length = np.diff(np.append(first, len(open_)))
        last = first + length - 1
        begins, ends = words.first[owner[open_[first]]], words.first[owner[open_[last]] + 1] - 1
        scores[first[open_[first] > begins]] += field.transitions[0]  # the word before is ordinary
        scores[last[open_[last] < ends]] += field.transitions[:, 0]
        label = viterbi(scores, first, length, field.transitions)
        marked = np.flatnonzero(label)
        out: dict[int, list[tuple[int, int, str]]] = {}
        if not len(marked):
            return out
        new = np.concatenate([[True], (np.diff(open_[marked]) > 1) | (np.diff(label[marked]) != 0) | (np.diff(owner[open_[marked]]) > 0)])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(marked)) - 1
        for a, b in zip(marked[heads].tolist(), marked[tails].tolist(), strict=True):
            i, j = int(open_[a]), int(open_[b])
            s, e = int(words.start[i]), int(words.end[j])
            head = words.data[s : int(words.end[i])].tobytes().decode("utf-8", "replace")
            tail = words.data[int(words.start[j]) : e].tobytes().decode("utf-8", "replace")
            s += len(head[: core(head)[0]].encode())
            e -= len(tail[core(tail)[1] :].encode())
            out.setdefault(int(owner[i]), []).append((s, e, LABELS[label[a]]))
        return out


def _pieces(column: pa.Array):
    """Slices of a binary column of about PIECE bytes; a longer text is a slice of its own."""
    low, size = 0, 0
    for i, n in enumerate(pa.compute.binary_length(column).fill_null(0).to_pylist()):
        if size and size + n > PIECE:
            yield column.slice(low, i - low)
            low, size = i, 0
        size += n
    if low < len(column):
        yield column.slice(low)


def find_spans(column: pa.Array, labeller: Labeller) -> list[tuple[list, list]]:
    """For each text of a binary column: the base spans, and all of them, in code points. What the field marks counts where
    it meets no base span."""
    out = []
    for piece in _pieces(column):
        texts = piece.to_pylist()
        marked = labeller.spans(piece)
        starts = np.concatenate([[0], np.cumsum([len(t or b"") for t in texts])])
        for k, raw in enumerate(texts):
            base = base_spans(raw.decode("utf-8", "replace")) if raw else []
            added = []
            if k in marked:
                points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)])
                for s, e, kind in marked[k]:
                    s, e = int(points[s - starts[k]]), int(points[e - starts[k]])
                    if s < e and not any(x < e and s < y for x, y, _ in base):
                        added.append((s, e, kind))
            out.append((base, listed(base + added) if added else base))
        release()
    return out


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base (their list), spans (the list of all) of every whole text.

    A span is kind:start:end in code points, the end exclusive; lists go by start, then by kind. Base spans are what the
    fixed patterns find; the field adds spans of its own kinds where no base span is. A null or empty text has none. A null id gets a row, repeated
    rows give a row each, an empty table gives none. Other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        labeller = Labeller(shared.value)
        for batch in batches:
            found = find_spans(batch.column(1), labeller)
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS[:4]]
            lists = [pa.array([written(x[i]) for x in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, *lists], ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base", "spans"])

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("raw"))
    return texts.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
