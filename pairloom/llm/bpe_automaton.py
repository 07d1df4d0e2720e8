"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens, and its language is the set of token sequences that the merges produce. It starts
with one state for every base symbol (the state behind it), in which every base symbol may follow. Then each merge
(u, v) in turn adds one gadget:

- a new state, the one behind uv, is a copy of the state behind v,
- the state behind u loses the arc v, since u v is now always merged,
- wherever there is an arc u, there is an arc uv as well.

All arcs of the automaton would be 49,408 times as many labels, so a state's default is to have every arc, and the
table holds the labels it lost. Labels are numbered so that these are few intervals: by a walk of the tree in which the
parent of uv is u, younger children first. The arc v takes with it the arcs of all labels that begin with v and were made since
(they would be copies of it): v's own number and those of its younger children, one interval. A state has 18 intervals on average,
which are merged, and are looked up by bisection: this is the transition table, compiled once for each Python worker.

Encoding goes through a word once, from left to right: the labels that end at each place come from a
label trie with failure links, and for each place there is exactly one of them that the table allows behind the token
that ends at its start. Decoding emits the labels of the arcs.

Texts are normalised and cut into words as the tokenizer's file says. A text with characters
beyond those for which the two steps are built here is normalised and cut by the library itself; merges are
always applied by the automaton. Special tokens' strings in a text give their ids.

Words repeat, so a Python worker keeps the results of a bounded number of words.

Edge cases: a null text counts as empty: no tokens, empty decoded text. Very long words cost time in
proportion to their length. Repeated rows give repeated results; an empty table an empty one.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

#: Words whose encodings a Python worker keeps at most, in each of two generations: some 50 MB.
CACHED_WORDS = 100_000
#: Stands for the end of a word in the label trie: a private character, which is no byte's symbol.
END = "\ue000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Automaton:
    """The labels of a tokenizer's JSON, and the transition table that its merges make."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.spec, self.suffix = spec, model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.labels = {i: t for t, i in self.ids.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.labels |= {i: t for t, i in self.special.items()}
        self.n = max(self.labels) + 1
        self.symbols = byte_symbols()
        merges = []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            merges.append((self.ids[a], self.ids[b], self.ids[a + b]))
        dead: set[int] = set()  # merges whose arc was gone when their turn came: they make no token
        while found := self._compile(merges, dead):
            dead |= found
        self._label_trie()

    def _compile(self, merges: list[tuple[int, int, int]], dead: set[int]) -> set[int]:
        """Numbers the labels and adds the gadgets; returns the merges that turn out to be dead."""
        self.born = [-1] * self.n
        children: dict[int, list[int]] = defaultdict(list)
        for rank, (u, _, uv) in enumerate(merges):
            if rank not in dead and self.born[uv] < 0:
                self.born[uv] = rank
                children[u].append(uv)
        self.number = number = [0] * self.n
        stop = [0] * self.n  # behind the numbers of a label's subtree
        at, todo = 0, [t for t in range(self.n) if self.born[t] < 0]
        while todo:
            t = todo.pop()
            if t < 0:
                stop[~t] = at
                continue
            number[t], at = at, at + 1
            todo.append(~t)
            todo += children[t]  # the youngest is on top
        ages = {t: [-self.born[c] for c in reversed(own)] for t, own in children.items()}

        lost: list[list[tuple[int, int]]] = [[] for _ in range(self.n)]
        for rank, (u, v, uv) in enumerate(merges):
            if rank in dead:
                continue
            x = number[v]
            if any(a <= x < b for a, b in lost[u]):
                if self.born[uv] == rank:
                    return {rank}
                continue
            own = children.get(v, ())
            younger = bisect_right(ages[v], -rank) if own else 0
            end = number[own[-1 - younger]] if younger < len(own) else stop[v]
            if self.born[uv] == rank:
                lost[uv] = lost[v].copy()
            lost[u].append((x, end))
        self.first, self.bounds = array("i", [0]), array("i")
        for intervals in lost:
            last = -1
            for a, b in sorted(intervals):
                if a <= last:
                    last = self.bounds[-1] = max(last, b)
                else:
                    self.bounds.extend((a, b))
                    last = b
            self.first.append(len(self.bounds))
        return set()

    def _label_trie(self) -> None:
        import ahocorasick

        trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.length = [0] * self.n
        for t, i in self.ids.items():
            last = bool(self.suffix) and t.endswith(self.suffix)
            label = t.removesuffix(self.suffix) if last else t
            if self.born[i] >= 0 or len(label) == 1:
                self.length[i] = len(label) + last
                trie.add_word(label + END if last else label, i)
        trie.make_automaton()
        self.trie = trie

    def step(self, t: int, x: int) -> bool:
        """Whether the state behind t has an arc x (which leads to the state behind x)."""
        lo = self.first[t]
        return not (bisect_right(self.bounds, self.number[x], lo, self.first[t + 1]) - lo) & 1

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word given in byte symbols."""
        t = self.ids.get(word + self.suffix, -1)
        if t >= 0 and self.length[t]:  # the sequence of this one token is in the language
            return [t]
        if self.suffix:
            word += END
        n = len(word)
        length, number, first, bounds, find = self.length, self.number, self.first, self.bounds, bisect_right
        ends = [-1] * (n + 1)  # the token that ends the correct sequence of word[:i]
        for end, x in self.trie.iter(word):
            i = end + 1
            if ends[i] >= 0 or (i == n - 1 and n > 1 and self.suffix):  # with word ends, the last symbol has its own labels
                continue
            j = i - length[x]
            if j:
                t = ends[j]
                if t < 0:
                    continue
                lo = first[t]
                if (find(bounds, number[x], lo, first[t + 1]) - lo) & 1:
                    continue
            ends[i] = x
        out, i = [], n
        while i > 0:
            t = ends[i]
            out.append(t)
            i -= length[t]
        return out[::-1]


#: Characters whose normal form, case and class are settled: ASCII, Latin-1 letters and signs.
PLAIN = re.compile("[\t-\r -~\xa1-\xac\xae-\xff]*")
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


class Encoder:
    def __init__(self, path: str):
        self.automaton = Automaton(path)
        self.plain = self._as_built()
        self.cut_special = re.compile("|".join(map(re.escape, sorted(self.automaton.special, key=len, reverse=True))) or r"(?!)")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the words before; those met again move up
        self.path, self.library = path, None
        self.labels = [self.automaton.labels.get(i, "") for i in range(self.automaton.n)]

    def _as_built(self) -> bool:
        """Whether the file asks for the normaliser and the pattern that are built here."""
        s = self.automaton.spec
        kinds = [x["type"] for x in (s["normalizer"] or {}).get("normalizers", [])]
        return kinds == ["NFC", "Replace", "Lowercase"] and "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in json.dumps(s["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")

    def _pieces(self, text: str) -> list[str]:
        """Words of a text; those of the library are in byte symbols already and are marked by a leading NUL."""
        if self.plain and PLAIN.fullmatch(text):
            return WORDS.findall(text.lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        normal = self.library.normalizer.normalize_str(text)
        return ["\0" + p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _word(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            a = self.automaton
            symbols = word[1:] if word[0] == "\0" and len(word) > 1 else "".join([a.symbols[b] for b in word.encode()])
            ids = array("I", a.encode_word(symbols)).tobytes()
        if len(self.cache) >= CACHED_WORDS:
            self.older, self.cache = self.cache, {}
        if len(word) < 200:
            self.cache[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts: list[bytes] = []
        cache, at = self.cache, 0
        for m in [*self.cut_special.finditer(text), None]:
            for w in self._pieces(text[at : m.start() if m else len(text)]):
                parts.append(cache.get(w) or self._word(w))
            if m:
                parts.append(array("I", [self.automaton.special[m[0]]]).tobytes())
                at = m.end()
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """The labels of the ids' arcs."""
        return " ".join([self.labels[i] for i in memoryview(ids).cast("I")])

    def rest(self) -> None:
        """Between tasks an idle worker keeps the newer words only."""
        self.older = {}


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, decoded: bool = True) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) and decoded, if asked for."""
    path = path or default_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                done = [e.encode(t or "") for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array(done, pa.binary())]
                if decoded:
                    columns.append(pa.array([e.decode(x) for x in done], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])
        e.rest()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary" + ", decoded string" * decoded)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, hashed where the texts are encoded."""
    path = path or default_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = []
                for t in part.column(1).to_pylist():
                    ids = e.encode(t or "")
                    rows.append((len(ids) // 4, sha256(ids).hexdigest(), sha256(e.decode(ids).encode()).hexdigest()))
                columns = list(zip(*rows, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        e.rest()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
