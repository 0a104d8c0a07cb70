"""Personal data in texts: base patterns, and spans added by weak supervision."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "name", "secret", "ssn")
KINDS = BASE_KINDS + ADDED_KINDS

# The base patterns. The look-behind of ip only skips starts inside a run of digits, which fail or fit as
# the run's first does; email is searched from each @ (see _emails), so both stay linear in a text's length.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# The gazetteers (first names in four languages, words that make a capitalised pair no person, lengths of
# bank account numbers by country, numbers that were only ever printed as examples, words that stand for a secret) and the
# cue words of the context labelers.
_TITLES = "Mr Mrs Ms Miss Dr Prof Sir Herr Frau Madame Monsieur Señor Señora".split()
_FIRST_NAMES = frozenset(
    "Alice Amanda Andrew Anthony Ashley Barbara Betty Brian Carol Charles Christopher Daniel David Deborah Donald Donna Edward Elizabeth Emily Emma George Helen James Jason Jeffrey Jennifer Jessica John Joseph Joshua "
    "Karen Kenneth Kevin Kimberly Laura Linda Lisa Margaret Mark Mary Matthew Melissa Michael Michelle Nancy Patricia Paul Rebecca Richard Robert Ronald Ruth Sandra Sarah Sharon Stephen Steven Susan Thomas Timothy William "
    "Amélie Antoine Camille Céline Chloé Claude François Guillaume Henri Isabelle Jacques Jean Julien Louise Marie Mathieu Nathalie Nicolas Olivier Philippe Pierre Sophie Sylvie Thierry Véronique Yves "
    "Andreas Anna Birgit Christian Dieter Friedrich Gisela Günter Hans Heike Heinz Horst Ingrid Jürgen Karl Katrin Klaus Lukas Manfred Markus Monika Otto Petra Sabine Stefan Ursula Uwe Werner Wolfgang "
    "Alejandro Ana Antonio Carlos Carmen Diego Dolores Elena Fernando Francisco Isabel Javier Jorge José Juan Juana Lucía Luis Manuel María Maria Miguel Pablo Pedro Pilar Rafael Ramón Rosa Teresa".split()
)
_NO_PERSON = frozenset(
    "Street Road Avenue Square Park Island Islands River Lake Mountain University College School Church Cathedral Hospital Station Airport Company Inc Ltd Group Bank Award Prize Act County City Bay Bridge Museum Theatre "
    "January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday "
    "Straße Platz Weg Universität Kirche Insel Rue Place Île Université Église Calle Plaza Isla Universidad Iglesia".split()
)
_IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28,
    HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22,
    SA=24, SC=31, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)
_PRINTED_SSN = frozenset("078-05-1120 219-09-9999 457-55-5462 123-45-6789".split())
_PLACEHOLDERS = frozenset("password passwort secret changeme change-me example placeholder required optional invalid missing unknown undefined your-token your_token your-password mypassword none null true false string".split())
_CUES = {
    "iban": "iban account bank konto compte cuenta".split(),
    "name": "name author contact by from dear signed".split(),
    "secret": "token secret password passwd pwd key apikey api_key auth bearer credential".split(),
    "ssn": "ssn social security sozialversicherung".split(),
}
_AGAINST = "version licen isbn issn doi build release http:// https:// chapter page figure commit sha1 sha256 md5 checksum digest hash order ticket part model serial article tracking".split()

_SECRET = re.compile(r"""(?i)(?<![A-Za-z0-9])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth)["']?[\x20\t]*[:=][\x20\t]*["']?([^\s"'<>]{6,})""")
_BLOB = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/=_-])")
_KNOWN = r"AKIA[0-9A-Z]{16}|gh[pousr]_\w{20,}+|sk-\w{20,}+|eyJ[\w.-]{20,}+"
_KNOWN_SECRET = re.compile(rf"(?<![\w+/-])(?:{_KNOWN})(?![\w+/=-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NAME = re.compile(rf"(?<!\w)(?:{'|'.join(_TITLES)})\.?\x20([A-ZÀ-Þ][a-zß-ÿ]+(?:\x20[A-ZÀ-Þ][a-zß-ÿ]+)?)")
_FIRST_NAME = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(_FIRST_NAMES))})(?:\x20[A-ZÀ-Þ][a-zß-ÿ]+)?(?!\w)")

LABELERS = 5


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed, then start. Matches that fail their test are dropped."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 16 <= m.end() - m.start() and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


_DIGIT = re.compile(r"[0-9]")


def _small(part: str) -> bool:
    return len(bare := part.lstrip("0")) <= 3 and int(bare or "0") <= 255


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that the base patterns miss, one at most a place; the labelers vote on them."""
    out = []
    if "=" in text or ":" in text:
        out += [("secret", *m.span(1)) for m in _SECRET.finditer(text)]
    if any(t in text for t in ("AKIA", "gh", "sk-", "eyJ")):
        out += [("secret", *m.span()) for m in _KNOWN_SECRET.finditer(text)]
    if _DIGIT.search(text):
        out += [("secret", *m.span()) for m in _BLOB.finditer(text)]
        if "-" in text:
            out += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        out += [("iban", *m.span()) for m in _IBAN.finditer(text)]
    if any(t in text for t in _TITLES):
        out += [("name", *m.span(1)) for m in _NAME.finditer(text)]
    if any(t in text for t in _FIRST_NAMES):
        out += [("name", *m.span()) for m in _FIRST_NAME.finditer(text)]
    return out


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """Each labeler's vote on a candidate: 1 personal data, -1 not, 0 abstains. By form, gazetteer, cue words before it,
    words near it that tell of something else, and the signs around it."""
    value = text[start:end]
    before = text[max(0, start - 40) : start].lower()
    if kind == "iban":
        form = 1 if _iban_ok(value) else -1
        known = 1 if _IBAN_LENGTHS.get(value[:2]) == len(value.replace(" ", "")) else -1
    elif kind == "ssn":
        form = -1 if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000" else 1
        known = -1 if value in _PRINTED_SSN else 0
    elif kind == "secret":
        form = 1 if _entropy(value) >= 3 and _DIGIT.search(value) else -1 if value.isalpha() and value.islower() else 0
        known = 1 if re.fullmatch(rf"(?:[0-9a-f]{{32,}}|{_KNOWN})", value) else -1 if value.strip(".,;:!?\"'").lower() in _PLACEHOLDERS else 0
    else:
        words = set(value.split(" "))
        form = 1 if before.rstrip(". ").rpartition(" ")[2] in _LOW_TITLES else 0
        known = -1 if words & _NO_PERSON else 1 if words & _FIRST_NAMES else 0
    cues = 1 if any(c in before for c in _CUES[kind]) else 0
    against = -1 if any(c in before or c in text[end : end + 12].lower() for c in _AGAINST) else 0
    last, following = before[-1:], text[end : end + 1]
    around = -1 if last in ("/", "#", "\\") or following in ("/", "\\") else 1 if last and last in "\"'(<[:=" else 0
    return form, known, cues, against, around


_LOW_TITLES = frozenset(t.lower() for t in _TITLES)


def features(kind: str, own: tuple[int, ...], value: str) -> tuple[int, ...]:
    """What the classifier sees, all small integers: kind, votes, and coarse length, digit share and entropy."""
    digits = sum(c in "0123456789" for c in value) / len(value)
    return ADDED_KINDS.index(kind), *own, min(3, len(value) // 12), int(2.999 * digits), min(3, int(_entropy(value)))


@dataclass(frozen=True)
class Model:
    """For each added kind its share of personal data and, for each labeler, the chance of each vote (-1, 0, 1) if not
    personal data and if so. weights: of the classifier's one-hot features. counts: accepted and rejected candidates by
    kind."""

    priors: dict[str, float]
    reliabilities: dict[str, tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...]]
    weights: tuple[float, ...]
    counts: dict[str, tuple[int, int]]

    def score(self, row: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(sum(self.weights[k] for k in _places(row)))))))


_SIZES = (4, 3, 4)
_WIDTH = 1 + len(ADDED_KINDS) * (1 + 3 * LABELERS) + sum(_SIZES)


def _places(row: tuple[int, ...]) -> list[int]:
    """The one-hot features of a row that are set: one for all, the kind, each labeler's vote by kind, the coarse numbers."""
    kind, own, rest = row[0], row[1 : 1 + LABELERS], row[1 + LABELERS :]
    base = 1 + kind * (1 + 3 * LABELERS)
    out = [0, base, *(base + 1 + 3 * j + v + 1 for j, v in enumerate(own))]
    at = 1 + len(ADDED_KINDS) * (1 + 3 * LABELERS)
    for v, size in zip(rest, _SIZES):
        out.append(at + v)
        at += size
    return out


def _one_hot(row: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(_WIDTH)
    out[_places(row)] = 1
    return out


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50, anchor: float = 3.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Two-class votes model: (prior, reliabilities[labeler, class, vote + 1], posterior of each pattern), from the majority.
    anchor pseudo-votes a labeler say that it is right more often than wrong, so that the classes keep their meaning where
    little is there to tell them apart."""
    posterior = np.clip(0.5 + 0.2 * patterns.sum(axis=1), 0.05, 0.95)
    prior, chance = 0.5, np.full((patterns.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        prior = float((weight[1].sum() + 1) / (weight.sum() + 2))
        for j in range(patterns.shape[1]):
            for v in (-1, 0, 1):
                chance[j, :, v + 1] = weight[:, patterns[:, j] == v].sum(axis=1) + anchor * np.array([0.4 - 0.3 * v, 0.4 + 0.3 * v])
        chance /= chance.sum(axis=2, keepdims=True)
        log = np.log([1 - prior, prior])[:, None] + sum(np.log(chance[j][:, patterns[:, j] + 1]) for j in range(patterns.shape[1]))
        posterior = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
    return prior, chance, posterior


def _train(rows: list[tuple[tuple[int, ...], int]], steps: int = 300) -> Model:
    """EM on the votes of each kind, then one logistic regression on the features against all posteriors, over all counts."""
    rows = sorted(rows)
    counts = np.array([n for _, n in rows], float)
    posterior = np.zeros(len(rows))
    priors, reliabilities, told = {}, {}, {}
    for k, kind in enumerate(ADDED_KINDS):
        here = np.array([j for j, (r, _) in enumerate(rows) if r[0] == k], int)
        if len(here):
            patterns = np.array([rows[j][0][1 : 1 + LABELERS] for j in here])
            priors[kind], chance, posterior[here] = expectation_maximisation(patterns, counts[here])
            reliabilities[kind] = tuple(tuple(map(tuple, c)) for c in chance.tolist())
    w = np.zeros(_WIDTH)
    if rows:
        x = np.array([_one_hot(r) for r, _ in rows])
        kinds = np.array([r[0] for r, _ in rows])
        share = counts / np.bincount(kinds, weights=counts)[kinds]  # kinds weigh the same, however often they occur
        share /= share.sum()
        for _ in range(steps):  # Newton steps of a ridge-penalised fit converge within a few rounds
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (share * (p - posterior)) + 1e-4 * w
            hess = (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
    model = Model(priors, reliabilities, tuple(w.tolist()), told)
    for row, n in rows:
        kept, dropped = told.get(ADDED_KINDS[row[0]], (0, 0))
        told[ADDED_KINDS[row[0]]] = (kept + n, dropped) if model.score(row) >= 0.5 else (kept, dropped + n)
    return model


def fit(docs: DataFrame, text: str = "text") -> Model:
    """The model of all candidates in all of docs. They are counted by feature pattern in each task, then over all tasks, so
    what reaches the driver is bounded by the number of patterns (at most 11,664 a kind), not by the documents. Base spans
    aren't up for a vote. Null and empty texts have no candidates; an empty table gives a model without
    evidence; other columns are ignored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                t = t.as_py() or ""
                for kind, a, b in _clear(candidates(t), base_spans(t)):
                    found[features(kind, votes(t, kind, a, b), t[a:b])] += 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in found], pa.list_(pa.int32())), pa.array(list(found.values()), pa.int64())], ["pattern", "n"])

    rows = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(count, "pattern array<int>, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return _train([(tuple(r["pattern"]), r["n"]) for r in rows])


def _clear(spans: list[tuple[str, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """spans without those that overlap a taken one or an earlier of their own; linear after sorting."""
    fixed = sorted((a, b) for _, a, b in taken)
    starts, reach = [a for a, _ in fixed], list(accumulate((b for _, b in fixed), max))
    out, end = [], 0
    for a, b, kind in sorted((a, b, kind) for kind, a, b in spans):
        k = bisect.bisect_left(starts, b)
        if a >= end and not (k and reach[k - 1] > a):
            out.append((kind, a, b))
            end = b
    return out


def spans_of(text: str, model: Model, least: float = 0.5) -> list[tuple[str, int, int]]:
    """All spans: the base ones, then those candidates that the classifier gives at least this probability."""
    base = base_spans(text)
    more = [(k, a, b) for k, a, b in _clear(candidates(text), base) if model.score(features(k, votes(text, k, a, b), text[a:b])) >= least]
    return base + sorted(more)


def find(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans (kind, start, end, in code points, end exclusive) of every row of docs.

    Whole texts, each by itself, without a shuffle. Null and empty texts have no spans; repeated rows are searched each;
    null keys stay null; an empty table gives no rows; other columns are ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t.as_py() or "", model)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["key", "spans"])

    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string"))
    return source.mapInArrow(run, f"key {source.schema[0].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("key", key)


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with each span of its text replaced by its kind in angle brackets, as <EMAIL>; of spans that overlap the first
    counts. Null and empty texts stay; repeated rows are changed each; an empty table gives no rows; every other column
    passes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text)
            clean = []
            for t in batch.column(k):
                t = t.as_py()
                parts, at = [], 0
                for kind, a, b in sorted(spans_of(t, model), key=lambda s: (s[1], -s[2])) if t else ():
                    if a >= at:
                        parts += [t[at:a], f"<{kind.upper()}>"]
                        at = b
                clean.append(t if t is None or not at else "".join(parts) + t[at:])
            yield batch.set_column(k, batch.schema.field(k), pa.array(clean, batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)
