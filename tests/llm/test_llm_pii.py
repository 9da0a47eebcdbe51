"""Personal data: patterns against plain regular expressions, the field on held-out variants."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from newsloom.llm import pii, queries

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(digits[::-1])]
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0 or kind == "phone" and 9 <= len(digits) <= 15):
                found.append((kind, *m.span()))
    return found


def some_card(deal):
    head = "4" + "".join(deal.choice("0123456789") for _ in range(14))
    return next(head + c for c in "0123456789" if pii.luhn(head + c))


def sentences(deal, n=400):
    fill = ["river", "and", "stone", "at", "the", "seven", "2024", "3.14", "dot", "Émile"]
    for _ in range(n):
        body = [deal.choice(fill) for _ in range(deal.randrange(1, 30))]
        for _ in range(deal.randrange(3)):
            body.insert(deal.randrange(len(body) + 1), deal.choice([
                lambda: f"ab.{deal.randrange(99)}@mail{deal.randrange(9)}.example.com", lambda: ".".join(str(deal.randrange(300)) for _ in range(4)),
                lambda: some_card(deal), lambda: f"+1 ({deal.randrange(200, 999)}) 555-{deal.randrange(1000, 9999)}", lambda: str(deal.randrange(10**15, 10**16))])())
        yield deal.choice(" \n").join(body)


def test_patterns_match_plain_ones():
    deal = random.Random(6)
    odd = ["a@b.c@d.e", "@x.y", "a@b", "a.b@c.d.", "1.2.3.4.5.6.7.8", "1.2.3", "+1+234567890", "+12 ( 34 5678901 )", "4 2 8", "a@@b.c", "0" * 50 + ".1.1.1"]
    odd += ["".join(deal.choice("a1@. +-(") for _ in range(40)) for _ in range(3000)]
    for text in [*odd, *sentences(deal)]:
        assert sorted(pii.base_spans(text)) == sorted(brute(text))
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + "+" * 100_000) == []


def test_zones_hold_every_trigger():
    deal = random.Random(7)
    for text in sentences(deal):
        for zone in (found := list(pii.zones(text))):
            assert all(pii.TOKEN.fullmatch(text, i, j) for i, j in zone) and all(a[1] <= b[0] for a, b in zip(zone, zone[1:]))
        spans = [t for z in found for t in z]
        assert all(any(i <= m.start() < j for i, j in spans) for m in pii.TRIGGER.finditer(text))


def test_field_finds_held_out_variants():
    deal = random.Random(1)
    weights = pii.train([text[z[0][0]:z[-1][1]] for text in sentences(deal, 300) for z in pii.zones(text)])
    right = made = false = 0
    for text in sentences(random.Random(2), 300):
        spans = [s for s in pii.base_spans(text) if s[0] in ("email", "phone")]
        more = set(pii.spans_of(text, weights)[1]) - set(pii.base_spans(text))
        false += sum(not re.search(r"555|^4[0-9]{15}$", text[i:j]) for _, i, j in more)  # numbers run together hide some from the patterns
        if spans:
            other, spans = pii.variant(text, spans, deal)
            made += len(spans)
            right += len(set(spans) & set(pii.spans_of(other, weights)[1]))
    assert right / made > 0.9 and false <= 10


def segmentations(n):
    """Every way to cut n tokens: (state, first, last), state 0 for single tokens outside."""
    if n == 0:
        yield []
        return
    for head in segmentations(n - 1):
        yield [*head, (0, n - 1, n - 1)]
    for i in range(max(0, n - pii.LONGEST), n):
        for head in segmentations(i):
            for k in range(len(pii.KINDS)):
                yield [*head, (k + 1, i, n - 1)]


def score_of(text, tokens, field, cut):
    before, total = 0, 0.0
    for state, i, j in cut:
        total += field.step[before][state]
        if state:
            total += sum(field.segment.get(f, (0.0,) * 4)[state - 1] for f in pii.features(text, tokens, i, j))
        before = state
    return total


def random_field(deal, texts):
    names = {f for t in texts for tokens in [[m.span() for m in pii.TOKEN.finditer(t)]] for j in range(len(tokens)) for i in range(j + 1) for f in pii.features(t, tokens, i, j)}
    states = len(pii.KINDS) + 1
    return pii.Field({f: tuple(deal.gauss(0, 1) for _ in pii.KINDS) for f in sorted(names)}, [[deal.gauss(0, 1) for _ in range(states)] for _ in range(states)])


def test_decoding_and_likelihood_against_all_segmentations():
    deal = random.Random(4)
    texts = ["5 at x.y", "call +1 415 555 2671", "a@b.c", "1.2.3.4 is host", "at mail dot com 7"]
    field = random_field(deal, texts)
    examples, expected = [(t, pii.base_spans(t)) for t in texts], 0.0
    for text, spans in examples:
        tokens = [m.span() for m in pii.TOKEN.finditer(text)]
        scores = [(score_of(text, tokens, field, cut), cut) for cut in segmentations(len(tokens))]
        best = max(scores, key=lambda s: s[0])[1]
        assert pii.decode(text, tokens, field) == [(pii.KINDS[s - 1], i, j) for s, i, j in best if s]
        entity = {i: (pii.KINDS.index(k) + 1, i, j) for k, i, j in pii.gold(text, tokens, spans)}
        right, at = [], 0
        while at < len(tokens):
            right.append(entity.get(at, (0, at, at)))
            at = right[-1][2] + 1
        expected += score_of(text, tokens, field, right) - math.log(sum(math.exp(s) for s, _ in scores))
    cases = pii.Cases(examples, together=2)
    weights = np.array([field.segment[f] for f in cases.names])
    step = np.array(field.step)
    value, by_weight, by_step = cases.likelihood(weights, step)
    assert math.isclose(value, expected, rel_tol=1e-9)
    for array, slopes in ((weights, by_weight), (step, by_step)):
        for _ in range(12):
            at = tuple(deal.randrange(n) for n in array.shape)
            array[at] += 1e-5
            up = cases.likelihood(weights, step)[0]
            array[at] -= 2e-5
            down = cases.likelihood(weights, step)[0]
            array[at] += 1e-5
            assert math.isclose((up - down) / 2e-5, slopes[at], rel_tol=1e-4, abs_tol=1e-4)


@pytest.mark.xfail(reason="eleven tokens are inside LONGEST, but the field does not score them above no entity", strict=False)
def test_address_of_eleven_tokens():
    weights = pii.train([text[z[0][0]:z[-1][1]] for text in sentences(random.Random(1), 300) for z in pii.zones(text)])
    written = "John dot Smith at mail dot example dot co dot uk"
    assert ("email", 12, 12 + len(written)) in pii.spans_of(f"river stone {written} words nothing", weights)[1]


def test_no_zones_to_train_on():
    empty = pii.train([])
    assert pii.spans_of("x 5 a@b.c", empty)[0] == [("email", 4, 9)]


def test_addresses_without_digits():
    fill, names = ["river", "stone", "words", "about", "nothing"], ["john", "mary.ann", "bob-lee", "x_y"]
    ways = [" at {}.{}", " AT {}.{}", " at {} dot {}", " At {} Dot {}", " [AT] {}.{}", " (AT) {} [DOT] {}", " (at) {} (dot) {}"]
    weights = pii.train([text[z[0][0]:z[-1][1]] for text in sentences(random.Random(1), 300) for z in pii.zones(text)])
    made = right = 0
    for way in ways:
        for name in names:
            for host, end in (("example", "com"), ("my-site", "org")):
                written = name + way.format(host, end)
                text = " ".join([*fill[:4], written, *fill])
                start = text.index(written)
                zone = [t for z in pii.zones(text) for t in z]
                assert any(i == start for i, _ in zone) and any(j == start + len(written) for _, j in zone), text
                made += 1
                right += ("email", start, start + len(written)) in pii.spans_of(text, weights)[1]
    assert right / made > 0.9
    far = "5 river stone at example.com then nothing"  # the name behind a word that follows another trigger
    assert far.index("example") in [i for z in pii.zones(far) for i, _ in z]
    for text in ("we met at home. Then we left", "look at this, nothing more", "at", "at .com"):
        assert list(pii.zones(text)) == []


def test_rows(spark, tmp_path):
    rows = [(1, "mail x.1@mail2.example.com or +1 (415) 555-2671 é", "p"), (2, None, "p"), (3, "", "p"), (None, "10.0.0.1", "p"), (4, "clean text only", "p")]
    rows += [(i, t, "p") for i, t in enumerate(sentences(random.Random(3), 60), 10)]
    spark.createDataFrame(rows, "doc_id long, text string, _pii string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.QUERIES["op8_pii"](spark, str(tmp_path)).collect()}
    for i, text, _ in rows:
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(brute(text or ""), key=lambda s: (list(PLAIN).index(s[0]), s[1])))
        assert found[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(found[i]["spans"].split(","))
    cleaned = {r["doc_id"]: r["text"] for r in pii.redacted(spark.createDataFrame(rows, "doc_id long, text string, _pii string")).collect()}
    assert cleaned[1] == "mail <email> or <phone> é" and cleaned[2] is None and cleaned[4] == "clean text only"
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
