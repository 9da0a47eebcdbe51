"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

Candidate segments are runs of up to ``LONGEST`` tokens in zones around digits, at-signs and spelled-out ones.  Features of the
whole segment (its shape, number of digits, checksum, neighbours) and the step from the segment before score it as one of
the kinds, and a dynamic program over the zone chooses boundaries and kinds together.  The weights are trained here, by
conditional likelihood (sums over all segmentations, forward and backward), on at most ``sample`` zones of the corpus,
labelled by the patterns and by variants of what they find (no leading plus, at-signs and dots spelled out, addresses
without digits).  Spans of the patterns always stay; the field adds spans that overlap none of them.  Null and empty
texts have no spans.  Neighbours of a trigger farther than 300 characters, and longer ones before it, are no part of its zone.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import ship_package

KINDS = ("email", "ip", "card", "phone")
LONGEST = 12  # tokens of a segment: a spelled-out address of six parts has eleven
NEVER = -1e30  # log of no chance at all
# Fixed patterns.  Possessive digits and the look-behind only save retries: no match can begin inside a run of digits.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The word "at" opens a zone where a dotted name, its dots written or spelled out, comes next
TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]|[\[(]dot[\])]|\bdot\b"
                     r"|\bat(?=[\x20\x09-\x0D]+[a-z0-9-]+(?:\.|[\x20\x09-\x0D]*[\[(]dot[\])][\x20\x09-\x0D]*|[\x20\x09-\x0D]+dot[\x20\x09-\x0D]+)[a-z0-9])", re.I)
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")

Span = tuple[str, int, int]


def digits_of(piece: str) -> str:
    return "".join(c for c in piece if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def small_parts(address: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in address.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: the run of local characters before an at-sign, then the domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    found = [("email", i, j) for i, j in emails(text)]
    if any(c in text for c in "0123456789"):
        found += [("ip", *m.span()) for m in IP.finditer(text) if small_parts(m[0])]
        found += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


def zones(text: str, around: int = 2) -> Iterator[list[tuple[int, int]]]:
    """Token spans of the zones: tokens with a trigger and ``around`` tokens on each side; zones that meet are one."""
    zone: list[tuple[int, int]] = []
    at = 0
    while hit := TRIGGER.search(text, at):
        left = max(text.rfind(c, at, hit.start()) + 1 for c in " \t\n\x0b\x0c\r") or at
        token = TOKEN.match(text, left) or TOKEN.match(text, hit.start())
        before, cursor = [], left
        while len(before) < around and cursor > (zone[-1][1] if zone else 0):  # step back token by token
            end = len(text[max(0, cursor - 300):cursor].rstrip(" \t\n\x0b\x0c\r")) + max(0, cursor - 300)
            start = max(text.rfind(c, max(0, end - 300), end) + 1 for c in " \t\n\x0b\x0c\r")
            if end <= start or start < (zone[-1][1] if zone else 0) or end - start >= 300:
                break
            before.insert(0, (start, end))
            cursor = start
        meets = zone and not text[zone[-1][1]:before[0][0] if before else token.start()].strip(" \t\n\x0b\x0c\r")
        if zone and not meets:
            yield zone
            zone = []
        zone += [*before, token.span()]
        at = cursor = token.end()
        for _ in range(around):
            nxt = TOKEN.search(text, cursor, min(len(text), cursor + 300))
            nxt = nxt and TOKEN.match(text, nxt.start())  # the whole token, where the search ends inside it
            if nxt is None or (hit := TRIGGER.search(text, nxt.start())) and hit.start() < nxt.end():  # what follows "at" is outside its token
                break
            zone.append(nxt.span())
            at = cursor = nxt.end()
    if zone:
        yield zone


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in "\"'[<{":
        start += 1
    while start < end and text[end - 1] in ".,;:!?\"'>]}":
        end -= 1
    return start, end


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Of the whole segment of tokens i to j."""
    start, end = trimmed(text, tokens[i][0], tokens[j][1])
    piece = text[start:end]
    digits = digits_of(piece)
    shape = re.sub("a+", "a", re.sub("d+", "d", "".join("d" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in piece[:80])))
    shape = re.sub("a( a)+", "a a", shape)  # any number of plain words
    letters = min(sum(c.isalpha() for c in piece), 3)
    count = len(digits) if len(digits) < 20 else 20
    said = text[tokens[i - 1][0]:tokens[i - 1][1]].lower().strip(":.,") if i else ""
    found = [f"tokens={min(j - i + 1, 8)}", f"digits={count}", f"shape={shape}" if len(shape) <= 24 else "shape=long", f"letters={letters}"]
    found.append(f"luhn={13 <= len(digits) <= 19 and luhn(digits)}&{letters == 0}")
    found.append(f"address={bool(IP.fullmatch(piece)) and small_parts(piece)}")
    mail = bool(re.fullmatch(r'[^@]+(@|[ ]?[\[(]at[\])][ ]?| at )[a-z0-9-]+((\.|[ ]?[\[(]dot[\])][ ]?| dot )[a-z0-9-]+)+', piece, re.I))
    found.append(f"dial={bool(re.fullmatch(r'[+]?[0-9]{0,3}[ .-]?[(]?[0-9]{2,4}[)]?([ .-]?[0-9]{2,4}){2,3}', piece))}&{9 <= len(digits) <= 15}&{letters}")
    if said in ("tel", "phone", "call", "mobile", "fax", "mail", "email", "ip", "host", "card", "visa"):
        found.append(f"said={said}")
    dots = ("dot", "(dot)", "[dot]")  # next to a segment they say that it is a part of something longer
    part = said in dots or j + 1 < len(tokens) and text[tokens[j + 1][0]:tokens[j + 1][1]].lower() in dots
    found.append(f"mail={mail}&part={part}")
    return found


class Field(NamedTuple):
    """Weights of a segment's features, one for each kind, and of steps from state to state (0: no entity; then the kinds)."""

    segment: dict[str, tuple[float, ...]]
    step: list[list[float]]


def decode(text: str, tokens: list[tuple[int, int]], field: Field) -> list[tuple[str, int, int]]:
    """The best segmentation of a zone, boundaries and kinds together: (kind, first token, last token) of its entities.

    A segment is one token outside all entities, or up to ``LONGEST`` tokens of one kind; the zone starts outside.
    """
    states, none = range(len(KINDS) + 1), (0.0,) * len(KINDS)
    enter: list[list[tuple[float, int]]] = []  # per place and next state: best score, from which state
    best: list[list[tuple[float, int, int]]] = [[(0.0, 0, 0), *((-math.inf, 0, 0) for _ in KINDS)]]  # score, start, state before
    for j in range(len(tokens)):
        enter.append([max((best[j][s][0] + field.step[s][t], -s) for s in states) for t in states])
        score, before = enter[j][0]
        row = [(score, j, -before)]
        tops = [(-math.inf, 0, 0)] * len(KINDS)
        for i in range(max(0, j - LONGEST + 1), j + 1):
            own = [field.segment.get(f, none) for f in features(text, tokens, i, j)]
            for k in range(len(KINDS)):
                score = enter[i][k + 1][0] + sum(w[k] for w in own)
                if score > tops[k][0]:
                    tops[k] = (score, i, -enter[i][k + 1][1])
        best.append(row + tops)
    chosen, j = [], len(tokens)
    state = max(states, key=lambda s: (best[j][s][0], -s))
    while j:
        _, i, before = best[j][state]
        if state:
            chosen.append((KINDS[state - 1], i, j - 1))
        j, state = i, before
    return chosen[::-1]


def gold(text: str, tokens: list[tuple[int, int]], spans: list[Span]) -> list[tuple[str, int, int]]:
    """Spans as segments, where their ends are those of trimmed segments."""
    found, free = [], 0
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        for i in range(free, len(tokens)):
            hit = next((j for j in range(i, min(len(tokens), i + LONGEST)) if trimmed(text, tokens[i][0], tokens[j][1]) == (start, end)), None)
            if hit is not None:
                found.append((kind, i, hit))
                free = hit + 1
                break
    return found


def variant(text: str, spans: list[Span], deal: random.Random) -> tuple[str, list[Span]]:
    """The text with one found span written another way, and its spans."""
    kind, start, end = deal.choice(spans)
    piece = text[start:end]
    if kind == "phone":
        piece = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", piece) if deal.random() < 0.7 else piece.replace(" ", ".")
    elif kind == "email":
        piece = piece.replace("@", deal.choice([" at ", " (at) ", " [at] "])).replace(".", deal.choice([".", " dot ", " [dot] "]))
    shift = len(piece) - (end - start)
    other = [(k, s + shift * (s >= end), e + shift * (s >= end)) for k, s, e in spans if (k, s, e) != (kind, start, end) and (e <= start or s >= end)]
    return text[:start] + piece + text[end:], [*other, (kind, start, start + len(piece))]


def plain_address(text: str, spans: list[Span], deal: random.Random) -> tuple[str, list[Span]]:
    """The text with one address replaced by one without digits, of few or many parts, spelled out."""
    kind, start, end = deal.choice([s for s in spans if s[0] == "email"])
    part = lambda: "".join(deal.choice("abcdefghij") for _ in range(deal.randrange(2, 9)))
    local = deal.choice([".", "-", "_", " dot "]).join(part() for _ in range(deal.choice([1, 2, 2])))
    host = ["-".join(part() for _ in range(deal.choice([1, 1, 1, 2]))) for _ in range(deal.choice([2, 2, 3, 4]))]
    piece = local + deal.choice([" at ", " at ", " (at) ", " [at] ", "[at]"]) + deal.choice([".", " dot ", " dot ", " [dot] ", " (dot) ", "[dot]"]).join(host)
    shift = len(piece) - (end - start)
    other = [(k, s + shift * (s >= end), e + shift * (s >= end)) for k, s, e in spans if (k, s, e) != (kind, start, end) and (e <= start or s >= end)]
    return text[:start] + piece + text[end:], [*other, (kind, start, start + len(piece))]


def summed(x: np.ndarray, axis: int) -> np.ndarray:
    """log of the sum of exp along an axis."""
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log Z of each zone, the marginals of all its segments, and the expected steps from state to state.

    ``scores``: zones x last token x number of tokens - 1 x kind, NEVER where there is no such segment.
    """
    n, width, longest, kinds = scores.shape
    ahead = np.full((n, width + 1, kinds + 1), NEVER)
    ahead[:, 0, 0] = 0.0
    enter = np.full((n, width, kinds + 1), NEVER)
    for t in range(1, width + 1):
        enter[:, t - 1] = summed(ahead[:, t - 1, :, None] + step, 1)
        most = min(longest, t)
        ahead[:, t, 0] = enter[:, t - 1, 0]
        ahead[:, t, 1:] = summed(enter[:, t - most:t, 1:][:, ::-1] + scores[:, t - 1, :most], 1)
    rows = np.arange(n)
    total = summed(ahead[rows, lengths], 1)
    behind = np.full((n, width + 1, kinds + 1), NEVER)
    behind[rows, lengths] = 0.0
    leave = np.full((n, width, kinds + 1), NEVER)
    for t in range(width - 1, -1, -1):
        most = min(longest, width - t)
        ends = np.arange(most)
        leave[:, t, 0] = behind[:, t + 1, 0]
        leave[:, t, 1:] = summed(scores[:, t + ends, ends] + behind[:, t + 1:t + 1 + most, 1:], 1)
        open_zone = t < lengths
        behind[open_zone, t] = summed(step + leave[open_zone, t, None, :], 2)
    marginals = np.zeros_like(scores)
    for t in range(1, width + 1):
        most = min(longest, t)
        marginals[:, t - 1, :most] = np.exp(np.minimum(
            enter[:, t - most:t, 1:][:, ::-1] + scores[:, t - 1, :most] + behind[:, t, None, 1:] - total[:, None, None], 0.0))
    steps = np.exp(np.minimum(ahead[:, :width, :, None] + step + leave[:, :, None, :] - total[:, None, None, None], 0.0)).sum((0, 1))
    return total, marginals, steps


class Cases:
    """Zones with their right segmentations, as arrays: each distinct set of segment features is one row of weights' sums."""

    def __init__(self, zones_and_spans: list[tuple[str, list[Span]]], together: int = 256) -> None:
        self.names: dict[str, int] = {}
        rows: dict[tuple[int, ...], int] = {}
        read = []
        for text, spans in zones_and_spans:
            tokens = [m.span() for m in TOKEN.finditer(text)]
            if not tokens:
                continue
            own = np.full((len(tokens), LONGEST), -1)
            for j in range(len(tokens)):
                for i in range(max(0, j - LONGEST + 1), j + 1):
                    found = tuple(self.names.setdefault(f, len(self.names)) for f in features(text, tokens, i, j))
                    own[j, j - i] = rows.setdefault(found, len(rows))
            read.append((own, [(KINDS.index(kind), i, j) for kind, i, j in gold(text, tokens, spans)]))
        read.sort(key=lambda c: len(c[0]))
        self.members = np.array([f for row in rows for f in row], np.int64)
        self.starts = np.cumsum([0, *(len(row) for row in rows)])[:-1]
        self.row_of = np.repeat(np.arange(len(rows)), [len(row) for row in rows])
        kinds = len(KINDS)
        self.right, self.right_steps, self.batches = np.zeros((len(rows) + 1, kinds)), np.zeros((kinds + 1, kinds + 1)), []
        for k in range(0, len(read), together):
            part = read[k:k + together]
            lengths = np.array([len(own) for own, _ in part])
            ids = np.full((len(part), lengths.max(), LONGEST), -1)
            for z, (own, segments) in enumerate(part):
                ids[z, :len(own)] = own
                entity, at, state = {i: (kind, j) for kind, i, j in segments}, 0, 0
                while at < len(own):
                    kind, last = entity.get(at, (-1, at))
                    if kind >= 0:
                        self.right[own[last, last - at], kind] += 1
                    self.right_steps[state, kind + 1] += 1
                    at, state = last + 1, kind + 1
            self.batches.append((ids, lengths))

    def likelihood(self, weights: np.ndarray, step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of the right segmentations, and its gradients by feature weights and by steps."""
        sums = np.add.reduceat(weights[self.members], self.starts, axis=0)
        sums = np.vstack([sums, np.full(len(KINDS), NEVER)])  # the last row: no segment
        value = float((sums[:-1] * self.right[:-1]).sum() + (step * self.right_steps).sum())
        expected, steps = np.zeros_like(sums), self.right_steps.copy()
        for ids, lengths in self.batches:
            total, marginals, each = forward_backward(sums[ids], lengths, step)
            value -= float(total.sum())
            steps -= each
            for k in range(len(KINDS)):
                expected[:, k] += np.bincount(np.where(ids < 0, len(sums) - 1, ids).ravel(), marginals[..., k].ravel(), len(sums))
        apart = (self.right - expected)[self.row_of]
        return value, np.stack([np.bincount(self.members, apart[:, k], len(self.names)) for k in range(len(KINDS))], 1), steps


def train(texts: list[str], rounds: int = 60, rate: float = 0.25, prior: float = 0.02, seed: int = 5) -> Field:
    """Semi-Markov CRF: zone texts labelled by the patterns, fitted by conditional likelihood with a Gaussian prior (Adam)."""
    deal, apart = random.Random(seed), random.Random(seed + 1)
    examples = []
    for text in texts:
        spans = base_spans(text)
        examples.append((text, spans))
        if spans:
            examples += [variant(text, spans, deal) for _ in range(2)]
        if any(kind == "email" for kind, _, _ in spans):
            examples += [plain_address(text, spans, apart) for _ in range(2)]
    cases = Cases(examples)
    if not cases.batches:
        return Field({}, [[0.0] * (len(KINDS) + 1) for _ in range(len(KINDS) + 1)])
    now = [np.zeros((len(cases.names), len(KINDS))), np.zeros((len(KINDS) + 1, len(KINDS) + 1))]
    mean, square = [np.zeros_like(w) for w in now], [np.zeros_like(w) for w in now]
    for k in range(1, rounds + 1):
        _, *slopes = cases.likelihood(*now)
        for p, slope in enumerate(slopes):
            slope = slope - prior * now[p]
            mean[p] = 0.9 * mean[p] + 0.1 * slope
            square[p] = 0.99 * square[p] + 0.01 * slope ** 2
            now[p] = now[p] + rate * (mean[p] / (1 - 0.9 ** k)) / (np.sqrt(square[p] / (1 - 0.99 ** k)) + 1e-8)
    return Field({name: tuple(now[0][k].tolist()) for name, k in cases.names.items()}, now[1].tolist())


def spans_of(text: str | None, weights: Field) -> tuple[list[Span], list[Span]]:
    """Spans of the patterns, and all spans: ordered by kind, then place."""
    text = text or ""
    key = lambda s: (KINDS.index(s[0]), s[1])
    base = sorted(base_spans(text), key=key)
    more: list[Span] = []
    for tokens in zones(text):
        for kind, i, j in decode(text, tokens, weights):
            start, end = trimmed(text, tokens[i][0], tokens[j][1])
            if start < end and not any(start < e and s < end for _, s, e in base):
                more.append((kind, start, end))
    return base, sorted(base + more, key=key)


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def zone_texts(docs: DataFrame, text: str, sample: int) -> list[str]:
    """At most ``sample`` zones (and as many documents), those with the smallest hash; at most 400 characters each."""
    body = docs.select(F.col(text).alias("text")).filter(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    chosen = body.select("h").distinct().orderBy("h").limit(sample)  # hashes, not texts, meet in one task
    few = body.join(F.broadcast(chosen), "h").dropDuplicates(["h"])

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[t[z[0][0]:z[-1][1]][:400] for z in zones(t)] for t in texts])

    found = few.select(F.explode(cut("text")).alias("zone")).distinct().orderBy(F.xxhash64("zone"), "zone").limit(sample)
    return [r["zone"] for r in found.collect()]


def personal_data(docs: DataFrame, text: str = "text", sample: int = 600) -> DataFrame:
    """``docs`` with a struct column ``_pii``: base and all spans as arrays of (kind, start, end); one of that name is replaced."""
    spark = docs.sparkSession
    ship_package(spark)
    weights = spark.sparkContext.broadcast(train(zone_texts(docs, text, sample)))
    span = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(f"base {span}, spans {span}")
    def each(texts: pd.Series) -> pd.DataFrame:
        found = [spans_of(t, weights.value) for t in texts]
        named = lambda side: [[{"kind": k, "start": s, "end": e} for k, s, e in f[side]] for f in found]
        return pd.DataFrame({"base": named(0), "spans": named(1)})

    return docs.withColumn("_pii", each(text))


def redacted(docs: DataFrame, text: str = "text", **how: int) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    in_order = F.sort_array(F.transform("_pii.spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    body = F.col(text)
    joined = F.aggregate(in_order, start, lambda done, s: F.struct(
        F.greatest(done["at"], s["end"]).alias("at"),
        F.when(s["start"] < done["at"], done["done"]).otherwise(F.concat(done["done"], F.substring(body, done["at"] + 1, s["start"] - done["at"]), F.lit("<"), s["kind"], F.lit(">"))).alias("done")),
        lambda done: F.concat(done["done"], F.substring(body, done["at"] + 1, F.length(body))))
    return personal_data(docs, text, **how).withColumn(text, F.when(F.size("_pii.spans") > 0, joined).otherwise(body)).drop("_pii")


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
