"""Toxicity by Levenshtein automata intersected with a lexicon trie.

The lexicon is learnt from labelled documents: words, and word beginnings, that documents marked toxic use and
others do not. Its entries form a trie; the trie intersected with Levenshtein automata (one edit, for words of
five letters and up) gives one deterministic automaton that reads every word of a batch in step. Words that are one edit from a
term but stand in documents not marked toxic are no misspellings: they join the trie as known words. Each hit is
read in its context window: quoted or reported terms weigh a fraction of those that abuse. A document's dose is the weighted
sum of its hits; a logistic model over dose and density gives the score.

Null, empty and wordless texts get the model's score for no hits. Repeated rows score alike, ties in the lexicon do not
matter as it has no size limit, and texts of any length are read whole. Without labels of both kinds every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import bytesops as B
from tidewater.llm.common import bounded_sample

#: At most this many labelled documents are learnt from (a bounded sample, which bounds the lexicon).
TRAIN_ROWS = 12_000
FUZZY_FROM = 5
EXACT, PREFIX, FUZZY, QUOTED = range(4)
#: What a hit of each kind adds to the dose.
DOSE = np.array([1.0, 1.0, 0.7, 0.2])
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDLESS = np.ones(256, bool)
_WORDLESS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Words that report another's words.
REPORTING = [b"said", b"says", b"quote", b"quoted", b"called", b"word", b"term", b"wrote", b"sagte", b"dijo", b"dit"]
WINDOW = 60


@dataclass
class Automaton:
    """``table[state, symbol]`` is the next state; state 0 is the sink, state 1 the start.

    ``verdict[state]``: -1 no term ends here, else EXACT or FUZZY; ``stem[state]``: a prefix term ended on the way.
    """

    symbol: np.ndarray
    table: np.ndarray
    verdict: np.ndarray
    stem: np.ndarray


def compile_lexicon(terms: list[bytes], stems: list[bytes], known_words: list[bytes] | tuple = ()) -> Automaton:
    """Subset construction over (trie node, edits used) pairs. ``known_words`` are read exactly and are no hits."""
    letters = sorted({b for t in [*terms, *stems, *known_words] for b in t})
    symbol = np.zeros(256, np.int64)  # 0: any byte that no term has
    for k, b in enumerate(letters, 1):
        symbol[b] = k
    children: list[dict[int, int]] = [{}]
    is_end, is_stem, is_known = [False], [False], [False]

    def add(word: bytes, kind: list[bool]) -> None:
        node = 0
        for b in word:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
                is_end.append(False)
                is_stem.append(False)
                is_known.append(False)
            node = children[node][b]
        kind[node] = True

    for t in terms:
        add(t, is_end)
    for t in stems:
        add(t, is_stem)
    for t in known_words:
        add(t, is_known)
    longest = [0] * len(children)  # of the terms below each node
    for t in terms:
        node = 0
        for b in t:
            longest[node] = max(longest[node], len(t))
            node = children[node][b]
        longest[node] = max(longest[node], len(t))

    def close(states: set) -> frozenset:
        """Deletions of a term's letter cost an edit."""
        out = set(states)
        for node, e in states:
            if e == 0 and longest[node] >= FUZZY_FROM:
                out |= {(c, 1) for c in children[node].values()}
        return frozenset(out)

    start = close({(0, 0)})
    known, todo, rows = {frozenset(): 0, start: 1}, [start], [[0] * (len(letters) + 1), None]
    while todo:
        at = todo.pop()
        row = []
        for b in [None, *letters]:
            nxt = set()
            for node, e in at:
                c = children[node].get(b)
                if c is not None:
                    nxt.add((c, e))
                if e == 0 and longest[node] >= FUZZY_FROM:
                    nxt.add((node, 1))  # a letter put in
                    nxt |= {(d, 1) for d in children[node].values()}  # a letter changed
            key = close(nxt)
            if key not in known:
                known[key] = len(rows)
                rows.append(None)
                todo.append(key)
            row.append(known[key])
        rows[known[at]] = row
    verdict, stem = np.full(len(rows), -1, np.int8), np.zeros(len(rows), bool)
    long_end = {n for n in range(len(children)) if is_end[n] and longest[n] >= FUZZY_FROM}
    for states, k in known.items():
        if any(e == 0 and is_end[n] for n, e in states):
            verdict[k] = EXACT
        elif any(e == 0 and is_known[n] for n, e in states):
            pass
        elif any(e == 1 and n in long_end for n, e in states):
            verdict[k] = FUZZY
        stem[k] = any(e == 0 and is_stem[n] for n, e in states)
    return Automaton(symbol, np.array(rows, np.int32), verdict, stem)


def read_words(auto: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """EXACT, PREFIX, FUZZY or -1 for each word; all words advance together, dead ones drop out."""
    out = np.full(len(starts), -1, np.int8)
    live, at, state = np.arange(len(starts)), starts.copy(), np.ones(len(starts), np.int64)
    while len(live):
        state = auto.table[state, auto.symbol[data[at]]]
        at = at + 1
        stems = auto.stem[state]
        done = at == ends[live]
        v = auto.verdict[state]
        hit = done & (v >= 0)
        out[live[hit]] = v[hit]
        out[live[stems & ~(hit & (v == EXACT))]] = PREFIX
        keep = ~done & (state > 0) & ~stems
        live, at, state = live[keep], at[keep], state[keep]
    return out


def quoted(data: bytes, start: int, end: int) -> bool:
    """Whether the window around a hit quotes it: open and closing quotation marks, or a reporting word before it."""
    before, after = data[max(0, start - WINDOW) : start], data[end : end + WINDOW]
    if (before.count(b'"') % 2 and b'"' in after) or (b"\xe2\x80\x9c" in before and b"\xe2\x80\x9d" in after) or (b"\xc2\xab" in before and b"\xc2\xbb" in after):
        return True
    return any(w in REPORTING for w in before.split()[-3:])


def _readable(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes, and the same with typographic quotation marks blanked, so that they do not stick to words."""
    data = B.ascii_lower(raw)
    bare = data.copy()
    pair = np.flatnonzero((raw[:-1] == 0xC2) & np.isin(raw[1:], [0xAB, 0xBB]))
    triple = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x80) & (raw[2:] >= 0x98) & (raw[2:] <= 0x9F))
    for at, size in ((pair, 2), (triple, 3)):
        for k in range(size):
            bare[at + k] = 0x20
    return data, bare


def count_hits(auto: Automaton, texts: pa.Array) -> np.ndarray:
    """For each text: exact, prefix, fuzzy and quoted hits, and words."""
    out = np.zeros((len(texts), 5))
    for row, raw, offsets in B.text_slices(texts):
        data, bare = _readable(raw)
        starts, ends, first = B.words(bare, offsets, _WORDLESS)
        if not len(starts):
            continue
        kind = read_words(auto, bare, starts, ends)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        for w in np.flatnonzero(kind >= 0):
            d = doc[w]
            a, b = offsets[d], offsets[d + 1]
            near = data[max(a, starts[w] - WINDOW) : min(b, ends[w] + WINDOW)].tobytes()
            k = int(starts[w] - max(a, starts[w] - WINDOW))
            if quoted(near, k, k + int(ends[w] - starts[w])):
                kind[w] = QUOTED
        for k in range(4):
            out[row : row + len(offsets) - 1, k] += np.bincount(doc[kind == k], minlength=len(offsets) - 1)
        out[row : row + len(offsets) - 1, 4] += np.diff(first)
    return out


def design(hits: np.ndarray) -> np.ndarray:
    """A row (1, any dose, log of the dose, dose by words) of each document's hits."""
    dose = hits[:, :4] @ DOSE
    return np.column_stack([np.ones(len(hits)), np.minimum(dose, 1), np.log1p(dose), np.minimum(1.0, 50 * dose / np.maximum(hits[:, 4], 1))])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps; no weight but the constant's may be negative, as a dose never speaks for a text."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -4, 4)
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    auto: Automaton
    weights: np.ndarray
    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)


def learn_lexicon(labelled: DataFrame, text: str, label: str, min_docs: int = 6, ratio: float = 12.0) -> tuple[list[str], list[str]]:
    """Terms and word beginnings that toxic documents use ``ratio`` times as often as others.

    A beginning (4 to 6 letters) must stand for at least 8 words of the toxic documents.
    """
    tox = F.col(label) == 1
    n1, n0 = labelled.agg(F.count_if(tox), F.count_if(~tox)).first()
    if not n1 or not n0:
        return [], []
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = labelled.select(tox.alias("y"), F.explode(F.array_distinct(F.split(lowered, SEPARATOR))).alias("w")).where(F.length("w").between(3, 40))
    counts = seen.groupBy("w").agg(F.count_if("y").alias("a"), F.count_if(~F.col("y")).alias("b")).cache()
    strong = (F.col("a") >= min_docs) & (F.col("a") / n1 >= ratio * (F.col("b") + 0.5) / n0)
    words = [(r["w"], r["a"]) for r in counts.where(strong).orderBy(F.desc("a"), "w").collect()]  # bounded by the sample
    stems: list[str] = []
    parts = counts.select(F.explode(F.array(*[F.struct(F.substring("w", 1, k).alias("s")) for k in (4, 5, 6)])).alias("x"), "w", "a", "b")
    begun = parts.where(F.length("w") > F.length("x.s")).groupBy("x.s").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count_if(F.col("a") > 0).alias("kinds"))
    good = begun.where((F.col("kinds") >= 8) & (F.col("a") >= 3 * min_docs) & (F.col("a") / n1 >= 2 * ratio * (F.col("b") + 0.5) / n0))
    for r in good.orderBy(F.length("s"), F.desc("a"), "s").collect():
        if not any(r["s"].startswith(s) for s in stems):
            stems.append(r["s"])
    counts.unpersist()
    return [w for w, _ in words if not any(w.startswith(s) for s in stems)], stems


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Learn from the labelled documents (``rows`` of them at most)."""
    pick = bounded_sample(labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("y")), "id", rows)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(pick, "id").select("text", "y").cache()
    terms, stems = learn_lexicon(chosen, "text", "y")
    entries = [t.encode() for t in terms], [s.encode() for s in stems]
    near = chosen.where("y <> 1").select(F.explode(_near_words(F.col("text"), compile_lexicon(*entries))).alias("w")).distinct()
    auto = compile_lexicon(*entries, sorted(r["w"].encode() for r in near.collect()))  # words of the sample, one edit from a term
    got = chosen.select(_hits(F.col("text"), auto).alias("h"), "y").toPandas()  # at most `rows` rows of five counts
    chosen.unpersist()
    if not len(got) or got["y"].nunique() < 2:
        return Model(auto, np.array([-30.0, 0, 0, 0]), terms, stems)
    x = design(np.array(got["h"].tolist(), float))
    return Model(auto, fit_logistic(x, got["y"].to_numpy(float)), terms, stems)


def _near_words(text: Column, auto: Automaton) -> Column:
    """The distinct words of each text that are one edit from a term."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        found: list[set] = [set() for _ in range(len(texts))]
        for row, raw, offsets in B.text_slices(texts):
            _, data = _readable(raw)
            starts, ends, first = B.words(data, offsets, _WORDLESS)
            if len(starts):
                for w in np.flatnonzero(read_words(auto, data, starts, ends) == FUZZY):
                    found[row + int(np.searchsorted(first, w, "right")) - 1].add(data[starts[w] : ends[w]].tobytes().decode())
        return pa.array([sorted(f) for f in found], pa.list_(pa.string()))

    return run(text)


def _hits(text: Column, auto: Automaton) -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        h = count_hits(auto, texts)
        return pa.ListArray.from_arrays(np.arange(0, 5 * len(h) + 1, 5, dtype=np.int32), pa.array(h.ravel()))

    return run(text)


def score(text: Column, model: Model) -> Column:
    """Probability that a text is toxic."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        x = design(count_hits(model.auto, texts))
        return pa.array(1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))))

    return run(text)
