"""Personal data by weak supervision.

Fixed patterns give the base spans (email, ip, card, phone). The method adds spans of the kinds name, local_phone,
national_id and written_email:

1. Patterns, a gazetteer of names and cue words propose candidates. The base patterns' matches, those that fail included, are
   candidates as well, so that the labelers can be judged by them.
2. Six labelers vote on each candidate for (1), against (-1) or not at all (0): its pattern (fully matched, failed, or only proposed), gazetteers (given
   names, words that no name ends with, top-level domains, card issuers, reserved numbers), cues before it, cues behind it, the characters
   at its edges, and other candidates nearby.
3. All candidates of all documents are counted by kind and votes (at most 8 * 3^6 rows). From these counts,
   expectation and maximisation find how reliable each labeler is and how often each kind is true.
4. The probabilities that follow from the votes train a logistic classifier over hashed features of the span and the words around it,
   which then decides on every candidate. It is trained on at most `SAMPLE` candidates of each kind, those whose hashes are smallest;
   candidates, counts and decisions cover all documents.

Base spans are found whatever the classifier says, and an added span overlaps none of them, nor a better added one. Spans are code
points, end exclusive.

Edge cases: a null text counts as empty: no spans. Repeated rows give repeated results (and vote again). Rows that share an id
are separate documents. An empty table gives an empty result; without any candidate the classifier finds nothing.
Very long texts are scanned whole, in time that grows with their length. Columns other than doc_id and text are ignored (and kept by `redact`).
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, settle, small_batches, table
from .weak_supervision import Reliabilities, logistic, predicted

# The patterns of the base spans (email is matched at its @, see `emails`).
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # no match ends inside of a number
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "name", "local_phone", "national_id", "written_email")
BASE = 4

# Patterns of the candidates that the method adds.
_NAME = "[A-Z][a-zß-öø-ÿ]+(?:-[A-Z][a-zß-öø-ÿ]+)?"
TITLED = re.compile(rf"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Monsieur|Madame)\.? ({_NAME}(?: {_NAME})?)\b")
PAIR = re.compile(rf"\b({_NAME}) (?:[A-Z]\. )?({_NAME})\b")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")
NATIONAL_ID = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
WRITTEN_EMAIL = re.compile(r"\b[A-Za-z0-9._-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{1,63}){1,5}\b")
WRITTEN_DOT = re.compile(r"[ (\[]dot[ )\]]")

# Gazetteers and cues.
GIVEN_NAMES = frozenset(
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen "
    "Daniel Nancy Matthew Lisa Anthony Betty Mark Margaret Paul Sandra Steven Ashley Andrew Emily George Donna Kevin Michelle Brian Laura "
    "Hans Peter Klaus Wolfgang Monika Ursula Sabine Jürgen Pierre Jacques Claude Nathalie Françoise Isabelle José Carlos Luis Carmen Pilar Javier".split()
)
NOT_NAMES = frozenset("Street Road Avenue University College School Hospital Bank Station Park Bridge River Lake Inc Ltd Corp Company Museum County City Day Award Prize Law".split())
DOMAINS = frozenset("com org net edu gov io de fr es uk eu us info biz co ch at it nl".split())
CUES = {
    "email": "email mail contact write reach correo courriel",
    "ip": "ip address host server from client login addr",
    "card": "card visa mastercard credit amex pay payment account karte tarjeta carte",
    "phone": "call phone tel telephone mobile cell fax contact reach text whatsapp",
    "name": "name contact dear sincerely regards called named signed mr mrs ms dr prof herr frau",
    "national_id": "ssn social security id identity",
}
CUES |= {"local_phone": CUES["phone"], "written_email": CUES["email"]}
BEFORE = {k: frozenset(v.split()) for k, v in CUES.items()}
BEHIND = {k: frozenset("ext extension or and please thanks said wrote says asked works lives born regards".split()) for k in KINDS}
DECOYS = frozenset("version v release isbn issn order invoice ticket serial model part page section chapter figure item sku build port rev no nr ref case docket flight".split())
UNITS = frozenset("ms kg usd eur px mb gb km miles items units percent pages points".split())

#: Candidates of a kind that the classifier is trained on at most; hashed features and how many a candidate has.
SAMPLE, SIZE, WIDTH = 4000, 1 << 14, 12
#: Score from which a candidate of an added kind is a span.
THRESHOLD = 0.5
NEAR, WINDOW = 200, 80
LABELERS = ("pattern", "gazetteer", "before", "behind", "edges", "nearby")
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: around each @, back to the last address or to where no letter of it can be."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(double[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """kind, start, end and whether the match holds, of all matches of the base patterns."""
    for s, e in emails(text):
        yield 0, s, e, True
    for m in IP.finditer(text):
        yield 1, *m.span(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m[0])
            if len(d) >= 13:
                yield 2, *m.span(), len(d) <= 19 and _luhn(d)
    for m in PHONE.finditer(text):
        yield 3, *m.span(), 9 <= len(_digits(m[0])) <= 15


def _more(text: str, has_digits: bool) -> Iterator[tuple[tuple[int, int, int], int]]:
    """Candidates of the added kinds: (kind, start, end), and the pattern's vote."""
    for m in TITLED.finditer(text):
        yield (4, *m.span(1)), 1
    for m in PAIR.finditer(text):
        if m[1] in GIVEN_NAMES or BEFORE["name"].intersection(w.lower() for w in TOKEN.findall(text[max(0, m.start() - 24) : m.start()])[-3:]):
            yield (4, *m.span()), 0
    if has_digits:
        for m in LOCAL_PHONE.finditer(text):
            yield (5, *m.span()), 1
        for m in NATIONAL_ID.finditer(text):
            yield (6, *m.span()), 1
    if WRITTEN_DOT.search(text):
        for m in WRITTEN_EMAIL.finditer(text):
            yield (7, *m.span()), 1


@dataclass
class Candidate:
    kind: int
    start: int
    end: int
    base: bool  # a base span
    votes: list[int]
    features: list[int]


def _gazetteer(kind: int, found: str) -> int:
    if kind == 0:
        return 1 if found.rpartition(".")[2].lower() in DOMAINS else -1
    if kind == 1:
        return -1 if found.split(".")[0].lstrip("0") in ("", "127", "255") else 0
    if kind == 2:
        return 1 if _digits(found)[0] in "3456" else -1
    if kind == 3:
        return -1 if found[1] == "0" else 1
    if kind == 4:
        words = found.split(" ")
        return -1 if words[-1] in NOT_NAMES else 1 if words[0] in GIVEN_NAMES else 0
    if kind == 5:
        return -1 if _digits(found)[0] in "01" else 0
    if kind == 6:
        return -1 if found[:3] in ("000", "666") or found[0] == "9" else 1
    return 1 if found.rpartition(" ")[2].rpartition(")")[2].rpartition("]")[2].lower() in DOMAINS else -1


def _described(text: str, kind: int, s: int, e: int, pattern: int, places: list[int]) -> Candidate:
    name, found = KINDS[kind], text[s:e]
    left = [w.lower() for w in TOKEN.findall(text[max(0, s - WINDOW) : s])[-4:]]
    right = [w.lower() for w in TOKEN.findall(text[e : e + WINDOW])[:3]]
    edge = text[max(0, s - 1) : s] + " " + text[e : e + 1]
    joined = any(c.isalnum() or c in "_/=#&?" for c in edge)
    at = bisect_left(places, s)
    near = any(0 < abs(p - s) <= NEAR for p in places[max(0, at - 1) : at] + places[at + 1 : at + 2])
    votes = [
        pattern,
        _gazetteer(kind, found),
        -1 if DECOYS.intersection(left) else int(bool(BEFORE[name].intersection(left))),
        -1 if UNITS.intersection(right) else int(bool(BEHIND[name].intersection(right))),
        -int(joined),
        int(near),
    ]
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[A-Z]", "A", re.sub("[^\\W\\d_A-Z]", "a", re.sub("[0-9]", "0", found[:64]))))
    words = [f"<{w if not w[0].isdigit() else '0'}" for w in left[::-1][:4]] + [f">{w if not w[0].isdigit() else '0'}" for w in right[:2]]
    marks = ["", f"shape {shape}", f"length {min(len(found), 40) // 4}", f"edge {joined}", f"near {near}", f"gazetteer {votes[1]}"]
    features = [1 + zlib.crc32(f"{name} {x}".encode()) % (SIZE - 1) for x in (marks + words)[:WIDTH]]
    return Candidate(kind, s, e, kind < BASE and pattern > 0, votes, features + [0] * (WIDTH - len(features)))


def candidates_of(text: str | None) -> list[Candidate]:
    """All candidates of a text, by kind and start; those of added kinds overlap no base span."""
    if not text:
        return []
    has_digits = re.search("[0-9]", text) is not None
    found = [(k, s, e, 1 if holds else -1) for k, s, e, holds in base_matches(text)] if has_digits or "@" in text else []
    base = sorted((s, e) for _, s, e, pattern in found if pattern > 0)
    # Base spans of several kinds may overlap: the farthest end so far tells whether one before reaches a candidate.
    starts, reach, top = [s for s, _ in base], [], 0
    for _, e in base:
        top = max(top, e)
        reach.append(top)

    def free(s: int, e: int) -> bool:
        at = bisect_left(starts, e)
        return at == 0 or reach[at - 1] <= s

    more: dict[tuple[int, int, int], int] = {}
    for place, pattern in _more(text, has_digits):
        more[place] = max(pattern, more.get(place, 0))
    found += [(*place, pattern) for place, pattern in more.items() if free(*place[1:])]
    places = sorted({s for _, s, _, _ in found})
    return [_described(text, *x, places) for x in sorted(found)]


def candidates(docs: DataFrame) -> DataFrame:
    """A row for each candidate: h (a hash for sampling), kind, votes and features."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [c for text in batch.column(0).to_pylist() for c in candidates_of(text)]
            columns = ([c.kind for c in rows], [c.votes for c in rows], [c.features for c in rows])
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "votes", "features"])

    return docs.select("text").mapInArrow(run, "kind int, votes array<int>, features array<int>")


@dataclass
class Model:
    """P(vote | truth) by labeler, P(truth) by kind, and the classifier's weights."""

    votes: np.ndarray
    kinds: np.ndarray
    weights: np.ndarray


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Reliabilities from the votes on all candidates, and a classifier from at most `sample` of each kind."""
    found = settle(candidates(docs), "candidates")
    counts = found.groupBy("kind", "votes").count().collect()  # at most 8 * 3^6 rows
    counts.sort(key=lambda r: (r.kind, r.votes))
    array = lambda rows, c, width: np.array([r[c] for r in rows], dtype=np.int64).reshape((len(rows), width) if width else len(rows))
    rel = Reliabilities(array(counts, "kind", 0), array(counts, "votes", len(LABELERS)), array(counts, "count", 0), len(KINDS), len(LABELERS))
    drawn = None
    for k in range(len(KINDS)):
        own = found.where(F.col("kind") == k).orderBy(F.xxhash64("features", "votes"), "features", "votes").limit(sample)
        drawn = own if drawn is None else drawn.unionByName(own)
    rows = sorted(drawn.collect(), key=lambda r: (r.kind, r.features, r.votes))
    discard(found)
    features = array(rows, "features", WIDTH)
    truth = rel.truth(array(rows, "kind", 0), array(rows, "votes", len(LABELERS)))
    return Model(rel.votes, rel.kinds, logistic(features, truth, SIZE))


def chosen(found: list[Candidate], scores: np.ndarray, threshold: float) -> list[tuple[Candidate, float]]:
    """Base spans, and of the other candidates those that reach the threshold and overlap no better one; by kind and start."""
    out = [(c, s) for c, s in zip(found, scores.tolist(), strict=True) if c.base]
    taken: list[tuple[int, int]] = []
    for score, c in sorted(((-s, c) for c, s in zip(found, scores.tolist(), strict=True) if c.kind >= BASE and s >= threshold), key=lambda x: (x[0], x[1].kind, x[1].start)):
        at = bisect_left(taken, (c.start, c.end))
        if (at == 0 or taken[at - 1][1] <= c.start) and (at == len(taken) or taken[at][0] >= c.end):
            taken.insert(at, (c.start, c.end))
            out.append((c, -score))
    return sorted(out, key=lambda x: (x[0].kind, x[0].start))


_SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))


def find(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The columns `keep` and spans, by kind and start."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("kept"), "text")
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found = candidates_of(text)
                scores = predicted(weights, np.array([c.features for c in found], dtype=np.int64).reshape(len(found), WIDTH))
                out.append([{"kind": KINDS[c.kind], "start": c.start, "end": c.end, "base": c.base, "score": s} for c, s in chosen(found, scores, threshold)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _SPAN_TYPE)], ["kept", "spans"])

    kept = rows.schema["kept"].dataType.simpleString()
    return rows.mapInArrow(run, f"kept {kept}, spans {_SPANS}").select("kept.*", "spans")


def redact(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The same rows and columns, with every span in text replaced by its kind in brackets (overlapping ones by one)."""
    d = find(docs.select("text", F.struct(*docs.columns).alias("row")), model, ("row",), threshold)
    text = F.col("row.text")
    by_place = F.transform(F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))), lambda x: x)
    state = F.aggregate(
        by_place,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(x["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit("["), x["kind"], F.lit("]"))).alias("out"),
        ),
    )
    new = F.when(F.size("spans") > 0, F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))).otherwise(text).alias("text")
    return d.select(*[new if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = find(docs, fit(docs))
    told = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    return d.select("doc_id", *[count(k) for k in KINDS[:BASE]], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
